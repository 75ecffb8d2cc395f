"""Fixed texts of deterministic answers: what a user reads must stay as it is."""

# --- fixed values: steps and likely causes by fix pattern ---
STEPS = {
    "Config-Environment": [
        "Verify the relevant configuration/feature-flag values for the affected customer or site.",
        "Compare configuration between the working and failing environments (stage vs prod).",
        "Update the incorrect configuration / enable the correct flag.",
        "Rerun the affected job or republish, then validate logs.",
    ],
    "Data Cleanup": [
        "Identify the bad or duplicate records driving the symptom.",
        "Correct or remove the affected data.",
        "Rerun the dependent process so downstream data refreshes.",
        "Add validation to prevent the bad data from recurring.",
    ],
    "Null Handling": [
        "Reproduce the case that produces the null/empty value.",
        "Inspect which field is null and why it is not populated upstream.",
        "Add a guard / default value and handle the null path safely.",
        "Add a regression test for the null scenario.",
    ],
    "Data Sync-Integration": [
        "Check the upstream/downstream sync status and the integration (e.g. Find API) health.",
        "Retry the failed message/job and confirm the payload mapping is correct.",
        "Re-map or re-publish the affected entity so data propagates.",
        "Validate the data now appears end-to-end.",
    ],
    "Access-Authorization": [
        "Verify the role / permission / token for the affected user or service.",
        "Check for duplicate or stale identity records (e.g. in AD).",
        "Update access or correct the identity mapping.",
        "Re-test the previously failing action.",
    ],
    "Performance": [
        "Review logs and timings for the slow operation.",
        "Identify the slow query/job/batch step.",
        "Optimize the query/batch or add appropriate retries/limits.",
        "Re-measure to confirm the latency is acceptable.",
    ],
    "Job-Workflow-Pipeline": [
        "Check the scheduler/job status and its dependencies.",
        "Rerun the failed step once blockers are cleared.",
        "Validate the job output and downstream artifacts.",
        "Add monitoring/alerting for the failure point.",
    ],
    "UI-Frontend": [
        "Reproduce the UI symptom and check the browser/network/API responses.",
        "Confirm the backing data/API returns the expected values.",
        "Fix the rendering/state-binding defect in the component.",
        "Verify the UI updates correctly after the change.",
    ],
    "Deployment/Version": [
        "Confirm the deployed version on the affected environment.",
        "Check the deployment/release notes for the relevant fix.",
        "Deploy the corrected version or roll back if needed.",
        "Validate the fix post-deployment.",
    ],
    "External Dependency": [
        "Confirm whether the failure originates in an external/third-party system.",
        "Engage the dependency owner with the captured evidence.",
        "Apply the agreed fix or workaround on the integration boundary.",
        "Validate end-to-end once the dependency is healthy.",
    ],
    "Logic Correction": [
        "Reproduce the incorrect result with a concrete example.",
        "Trace the rule/calculation producing the wrong value.",
        "Correct the logic and cover edge cases.",
        "Add a test asserting the correct result.",
    ],
    "Workaround-Manual": [
        "Apply the documented manual workaround to unblock the user.",
        "Capture the manual steps and affected scope.",
        "Plan a permanent fix to remove the manual effort.",
        "Track recurrence until the permanent fix ships.",
    ],
    "Unknown": [
        "Triage using the most similar historical defects below.",
        "Reproduce the issue and capture logs/error signatures.",
        "Compare with the cited fixed defects and apply the closest fix.",
        "Validate and, if unresolved, escalate with the gathered evidence.",
    ],
}
LIKELY_CAUSES = {
    "Config-Environment": "a configuration or feature-flag difference between the affected environment/data center and the working ones (e.g. a missing or incorrect setting).",
    "Data Cleanup": "bad, duplicate, or stale records driving the incorrect behavior.",
    "Null Handling": "a missing/null value that is not populated upstream and is not safely guarded.",
    "Data Sync-Integration": "a data synchronization or integration gap so the expected data did not propagate end-to-end.",
    "Access-Authorization": "an incorrect role/permission/token or a stale identity mapping.",
    "Performance": "an unoptimized query/job/batch step causing slow or timing-sensitive behavior.",
    "Job-Workflow-Pipeline": "a failed or stuck scheduled job/workflow step or an unmet dependency.",
    "UI-Frontend": "a rendering or state-binding defect, or the backing API returning unexpected values.",
    "Deployment/Version": "a version/deployment mismatch where the fix is missing on the affected environment.",
    "External Dependency": "a fault originating in an external/third-party system the feature depends on.",
    "Logic Correction": "an incorrect rule/calculation producing the wrong result for certain cases.",
    "Workaround-Manual": "a gap that currently requires a manual step, pointing to an underlying process/data issue.",
    "Unknown": "a configuration, data, or integration issue specific to the affected environment, based on the closest historical defects below.",
}
DEFECT_HEADER = "### 🗂️ From Historical Defects (defect knowledge base)"
DOC_HEADER = "### 📄 From Documentation (RAG knowledge base)"
# --- end of fixed values ---
