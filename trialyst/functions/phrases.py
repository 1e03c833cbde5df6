"""Fixed values of the conversation corpora: phrases, prompts and step texts.

Slots in braces are filled per row. Longer system prompts are parameters of
the operators that use them.
"""

# fixed values: phrases one of which is woven in before the first test run
VERIFY_V1 = [
    "Before I submit, I'd like to check this actually works.",
    "Let me run the tests to be sure.",
    "I'll verify this by executing the tests now.",
    "Quick sanity check — running the tests against this implementation.",
    "Worth verifying before I call this done.",
    "Let me confirm the behavior by running the tests.",
    "Running the tests to make sure I haven't missed a case.",
    "One quick execution to validate this.",
    "Let me prove it works by running the tests.",
    "Now I'll run it against the provided tests.",
    "Executing the tests against this draft.",
    "Verifying correctness before submission.",
    "Let me actually run it — I want to see green before submitting.",
    "A quick test run to double-check.",
    "I'd rather verify now than ship a regression.",
    "Let me run this through the tests.",
    "Running the test harness on this attempt.",
    "Let me see it pass before submitting.",
    "Kicking off the tests to confirm.",
    "Before finalizing, I'll run the test suite.",
]
# the later version leaves three of them out
VERIFY_V3 = [
    p
    for p in VERIFY_V1
    if p
    not in (
        "One quick execution to validate this.",
        "I'd rather verify now than ship a regression.",
        "Let me see it pass before submitting.",
    )
]
FAIL_TO_FIX = [
    "That's a real failure — let me correct it.",
    "The test is right, my code is wrong. Fixing.",
    "OK, that confirms the bug. Applying the correction.",
    "I need to fix this before submitting.",
    "Clear bug — let me patch it.",
    "Reproduced the issue. Now the fix.",
    "I can see the flaw now. Correcting it.",
    "The failure points directly at the bug. Let me address it.",
    "That gives me the exact spot to fix.",
    "The error trace is unambiguous — time to correct the implementation.",
]
VERIFY_FIX_V1 = [
    "Re-running the tests to confirm the fix holds.",
    "Let me verify the correction actually solves it.",
    "Running the tests against the fixed version.",
    "Checking that the revised code passes.",
    "Let me confirm the patch works by re-executing.",
    "Re-executing to make sure the fix sticks.",
    "Running the tests one more time on the corrected implementation.",
    "Second pass — verifying the fix.",
    "Validating the correction with the same tests.",
    "Let me confirm we're green now.",
]
VERIFY_FIX_V3 = [p for p in VERIFY_FIX_V1 if p != "Second pass — verifying the fix."]
RETRY = [
    "Still failing — my fix didn't address the full picture. Let me reconsider.",
    "That didn't resolve it. I missed something.",
    "The correction wasn't enough; the test is still unhappy. Let me look again.",
    "Still red. I need to rethink this.",
    "The patch didn't take. Let me dig deeper into what the traceback is telling me.",
    "Not yet — the same test is still failing. Let me look more carefully.",
]
CONFIRM_V1 = [
    "All green — submitting.",
    "Tests pass. This is ready.",
    "Everything checks out. Submitting the solution.",
    "Perfect — tests all pass. Done.",
    "Confirmed working. Final answer.",
    "That's it — submitting.",
]
CONFIRM_V3 = [p for p in CONFIRM_V1 if p != "Perfect — tests all pass. Done."]
FIX_LEAD = "Here is the fix:"

# fixed values: agentic corpus
STUDENT_PROMPT = (
    "You are an autonomous engineer agent. Use the provided tools "
    "(write_file, read_file, bash) to solve the user's task. "
    "For visual tasks, render the artifact to a PNG via bash and "
    "use read_file to view it before revising. "
    "When the task is complete, emit <final>OK</final> in your final "
    "assistant message and stop calling tools."
)
SCREENSHOT = "screenshot:"
RENDERED = "rendered screenshot(s):"

# fixed values: prompt of a repair task and of a rewarded trajectory
REPAIR_PROMPT = (
    "Fix the bug in this code.\n\n{description}\n\n"
    "You can verify your fix against these tests via the execute_code tool:\n"
    "```python\n{test_code}\n```"
)
REWARD_PROMPT = (
    "You are an AI agent solving a task step by step.\n"
    "Budget: {budget} steps.\n"
    "Task type: {task_type}\n\n"
    "Task:\n{task}\n\n"
    "Solve this task. Use [EXECUTE] to test your solution, "
    "[REVIEW] to analyze feedback, and [SUBMIT] when done.\n"
    "Output complete code/content in every [GENERATE] response."
)

# fixed values: step texts of the synthetic traces
CODE = {
    "hint": "edge case handling error",
    "generate_in": "[BUDGET: 5 steps remaining]\n[TASK]: Fix the bug in this code.\n\n{desc}\n\n[TEST CODE]:\n```python\n{tests}\n```",
    "generate_out": "[GENERATE]:\n```python\n{code}\n```",
    "no_code": "# Code for task (bug: {hint})\npass",
    "fixed_code": "# Fixed version addressing: {hint}\n{code}",
    "execute_in": "[EXECUTE]: Run the code against test cases.",
    "passed": "PASSED: all test assertions succeeded.",
    "failed": "FAILED: test assertions did not pass.",
    "stderr": (
        "FAILED: test assertions did not pass.\n\n--- stderr ---\n"
        "AssertionError: Test assertion failed.\nThe code does not correctly handle: {hint}\n"
        "Traceback (most recent call last):\n  File \"test_script.py\", line 1, in <module>\n"
        "    assert candidate(...) == expected\nAssertionError"
    ),
    "review_in": "[BUDGET: 4 steps remaining]\nTests failed. The error indicates: {hint}\nAnalyze the error and identify the root cause.",
    "review_out": "[REVIEW]: The test failure is caused by: {hint}. The fix requires modifying the code to properly handle this case. I will revise the implementation.",
    "revise_in": "[BUDGET: 3 steps remaining]\nRevise the code to fix: {hint}",
    "rerun_in": "[EXECUTE]: Run the revised code against test cases.",
    "again_in": "[BUDGET: {left} steps remaining]\nTests failed. Analyze the error.",
    "again_out": "[REVIEW]: Attempt {attempt} — the previous fix didn't address the root cause. The issue is: {hint}. Trying a different approach.",
    "again_run": "[EXECUTE]: Run the revised code.",
    "submit_in": "[DECISION]: Should I submit or continue iterating?",
    "submit_out": "[SUBMIT]: Tests pass. Submitting solution.",
    "spent_in": "[BUDGET: 0 steps remaining]\n[DECISION]: Budget exhausted. Submit current best.",
    "spent_out": "[SUBMIT]: Budget exhausted. Submitting best attempt.",
}
VISUAL = {
    "generate_in": "[BUDGET: 3 steps remaining]\n[TASK]: Create a {kind} as a self-contained HTML file.\n\n{desc}\n\nRequirements:\n{reqs}",
    "generate_out": "[GENERATE]:\n```html\n{code}\n```",
    "stub": (
        '<!DOCTYPE html>\n<html lang="en">\n<head>\n  <meta charset="UTF-8">\n'
        '  <meta name="viewport" content="width=device-width, initial-scale=1.0">\n  <title>{title}</title>\n'
        "  <style>\n    /* Styles for {kind} */\n    body {{ margin: 0; padding: 20px; font-family: sans-serif; }}\n"
        "  </style>\n</head>\n<body>\n{items}\n  <!-- Content based on: {desc} -->\n</body>\n</html>"
    ),
    "execute_in": "[EXECUTE]: Render the HTML and capture a screenshot for visual review.",
    "execute_out": "[EXECUTE]: Rendering HTML in headless browser.",
    "score": "Visual quality score: {q}.",
    "issues": "Visual quality score: {q}.\nIssues detected:\n- [{level}] {issue}",
    "fine": "Visual quality score: {q}.\nRendering looks correct. All requirements appear met.",
    "none": "No major issues",
    "issue": "layout or visual issues",
    "review_in": "[BUDGET: 2 steps remaining]\nVisual review found issues. Quality: {q}.\nIssue: {issue}",
    "review_out": "[REVIEW]: The rendered output has visual problems: {issue}. I need to fix the CSS layout and ensure all content is properly visible within the viewport.",
    "revise_in": "[GENERATE]: Revise the HTML to fix visual issues.",
    "rerun_in": "[EXECUTE]: Re-render and review the revised HTML.",
    "submit_in": "[DECISION]: Should I submit or continue iterating?",
    "submit_good": "[SUBMIT]: Quality is {q}. Meets threshold.",
    "submit_best": "[SUBMIT]: Quality is {q}. Submitting best attempt.",
}
VIDEO = {
    "generate_in": "[BUDGET: 3 steps remaining]\n[TASK]: Write a video editing script.\n\n{desc}\n\nSource video: {source}\n\nRequirements:\n{reqs}",
    "generate_out": "[GENERATE]:\n```python\n{code}\n```",
    "stub": "from moviepy import VideoFileClip\n\n# Task: {desc}\nclip = VideoFileClip('{source}')\n# TODO: Apply edits\nclip.write_videofile('/tmp/output.mp4')\n",
    "source": "input.mp4",
    "execute_in": "[EXECUTE]: Execute the script, extract keyframes, and review via VLM.",
    "failed": "EXECUTION FAILED:\nScript raised an error during video processing.\nCommon issue: {issue}",
    "fail_issue": "Runtime error in video processing",
    "ran": "Script executed. Keyframe quality: {q}.",
    "issue": "script error",
    "review_failed": "[BUDGET: 2 steps remaining]\nExecution failed.\nIssue: {issue}",
    "review_in": "[BUDGET: 2 steps remaining]\nKeyframe review found issues.\nIssue: {issue}",
    "review_out_failed": "[REVIEW]: The script has a runtime error. I need to fix the code — likely related to: {issue}.",
    "review_out": "[REVIEW]: The keyframes show issues: {issue}. Adjusting the processing parameters.",
    "revise_in": "[GENERATE]: Fix the script and output the complete corrected version.",
    "rerun_in": "[EXECUTE]: Re-execute and verify keyframes.",
    "rerun": "Keyframe quality: {q}.",
    "submit_in": "[DECISION]: Submit or iterate?",
    "submit_out": "[SUBMIT]: Quality {q}. Submitting.",
}
RESEARCH = {
    "generate_in": "[BUDGET: 2 steps remaining]\n[TASK]: Write a factual research report.\n\n{desc}\n\nMust cover:\n{reqs}",
    "generate_out": "[GENERATE]:\n{code}",
    "stub": "# Research Report\n\n{desc}\n\n{sections}",
    "section": "## {name}\n[Content for this section]",
    "execute_in": "[EXECUTE]: Fact-check the report claims against reliable sources.",
    "execute_out": "[EXECUTE]: Running factual verification on all claims.",
    "verified": "Factual accuracy: {q}. All claims verified.",
    "errors": "Factual accuracy: {q}. Some claims need correction — specific errors identified in the verification report.",
    "review_in": "[BUDGET: 1 step remaining]\nFact-checking found errors. Accuracy: {q}.",
    "review_out": "[REVIEW]: Some factual claims were contradicted by verification. I need to correct the specific numbers, dates, and attributions that failed fact-checking.",
    "revise_in": "[GENERATE]: Revise the report to fix factual errors.",
    "rerun_in": "[EXECUTE]: Re-verify the corrected report.",
    "rerun": "Factual accuracy: {q}.",
    "submit_in": "[DECISION]: Submit or iterate?",
    "submit_out": "[SUBMIT]: Accuracy {q}. Submitting.",
}
