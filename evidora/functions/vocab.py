"""Fixed values of the evidence model: word lists, cues, weights and limits that results depend on."""

# --- fixed values -----------------------------------------------------------------------------------
FIXED_STATUSES = ["fixed", "done", "closed", "resolved", "completed", "verified"]
CANCELLED_STATUSES = ["cancelled", "canceled", "won't do", "wont do", "won't fix", "wont fix", "rejected", "duplicate", "not a bug", "not a defect", "as designed"]
FIXED_RESOLUTIONS = ["fixed", "done", "resolved", "completed"]
CANCELLED_RESOLUTIONS = ["won't do", "wont do", "won't fix", "wont fix", "rejected", "duplicate", "cannot reproduce", "not a bug", "as designed"]

STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "and", "but", "or", "if", "this",
    "that", "these", "those", "what", "which", "who", "how", "why", "when", "where", "it", "its", "i", "we", "you", "they", "them", "their", "our",
    "my", "me", "show", "tell", "about", "please", "need", "want", "get", "give", "there", "here", "any", "all",
]

#: An issue key.
KEY = r"\b([A-Z][A-Z0-9]+-\d{2,})\b"

#: Masks in order: name, a sign that every match holds (if any), pattern, mark.
MASKS = [
    ("user", "User:", r"User:[0-9]+:[0-9a-fA-F-]+", "[user]"),
    ("email", "@", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[email]"),
    ("url", "://", r"https?://[^\s)\]]+", "[url]"),
    ("id", "-", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "[id]"),
    ("ip", ".", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[ip]"),
    ("phone", "", r"(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)", "[phone]"),
    # Long opaque strings, but never an issue key.
    ("token", "", r"(?i)\b(?!(?-i:[A-Z][A-Z0-9]+-\d{2,})(?![A-Za-z0-9_\-]))(?:bearer\s+)?[A-Za-z0-9_\-]{32,}\b", "[token]"),
]

ERROR_PATTERNS = [
    r"\b\d{3}\s*(?:bad request|error|internal server error|not found|unauthorized|forbidden|timeout)\b",
    r"\b(?:http\s*)?[45]\d{2}\b",
    r"\b[A-Z][A-Za-z]*(?:Exception|Error|Failure|Timeout)\b",
    r"\bnull\s*pointer\b",
    r"\bnullpointer\b",
    r"\b(?:publish|sync|mapping|validation|login|deployment|api|find\s*api|job|export)\s*(?:failed|failure|error|missing|rejected)\b",
    r"\b(?:failed|failure|rejected|missing|mismatch|duplicate|not\s+(?:populating|loading|reflecting|syncing|available|associated))\b",
    r"\btimed?\s*out\b",
    r"\btimeout\b",
]

FIX_PATTERN_CUES = {
    "Data Sync-Integration": ["sync", "integration", "find api", "findapi", "publish", "eom", "upstream", "downstream", "payload", "mapping", "remap", "api call"],
    "Config-Environment": ["config", "configuration", "feature flag", "ff ", "environment", "stage", "prod", "setting", "permission flag", "toggle", "variation"],
    "Data Cleanup": ["data mismatch", "duplicate", "bad record", "correct data", "data correction", "cleanup", "data issue", "incorrect data", "wrong data", "stale data"],
    "Null Handling": ["null", "empty", "missing value", "nullpointer", "null pointer", "blank", "not set", "undefined"],
    "Access-Authorization": ["permission", "access", "role", "token", "auth", "authorization", "unauthorized", "forbidden", "ad ", "active directory"],
    "Performance": ["slow", "performance", "timeout", "timed out", "delay", "latency", "load time", "optimi", "throughput"],
    "Job-Workflow-Pipeline": ["job", "scheduler", "pipeline", "workflow", "rerun", "batch", "trigger", "cron", "task failed"],
    "UI-Frontend": ["ui", "dashboard", "widget", "screen", "page", "display", "render", "frontend", "button", "grid", "label not", "not displaying"],
    "Deployment/Version": ["deploy", "deployment", "release", "version", "build", "rollback", "patch"],
    "External Dependency": ["third party", "third-party", "external", "vendor", "nanoprecise", "skyspark", "sfdc", "salesforce"],
    "Logic Correction": ["logic", "calculation", "incorrect result", "algorithm", "rule", "condition", "wrong value", "computation"],
    "Workaround-Manual": ["workaround", "manual", "manually", "temporary fix", "temp fix"],
}
DEFECT_TYPE_CUES = {
    "data issue": ["data mismatch", "duplicate", "data not", "incorrect data", "missing data", "wrong value", "stale"],
    "configuration issue": ["config", "feature flag", "setting", "mapping", "not configured"],
    "environment issue": ["environment", "prod only", "only in prod", "stage", "deployment"],
    "integration issue": ["sync", "integration", "api", "find api", "publish", "payload", "external"],
    "performance issue": ["slow", "performance", "timeout", "delay", "latency"],
    "access issue": ["permission", "access", "role", "token", "auth", "unauthorized"],
    "functional bug": ["error", "exception", "failed", "incorrect", "not working", "broken", "bug"],
}
ROOT_CAUSE_CUES = ["root cause", "because", "due to", "caused by"]
FIX_CUES = ["fixed", "resolved", "corrected", "updated", "added", "enabled", "rerun", "remap", "deployed"]
WORKAROUND_CUES = ["workaround", "temporar", "manually", "for now"]

DIAGNOSTIC_CUES = [
    "root cause", "why is", "why does", "why are", "why did", "how to fix", "how do i fix", "how was", "fix steps", "steps to fix", "failing", "failure",
    "error", "exception", "resolve", "resolution for", "workaround", "broken", "not working", "issue with", "problem with", "troubleshoot", "diagnose",
    "earlier fix", "historical fix", "fixed earlier", "fixed before",
    "not showing", "not show", "not shown", "not displaying", "not displayed", "not visible", "not appearing", "not appear", "not loading", "not load",
    "not populating", "not populated", "not coming", "not reflecting", "not updating", "not updated", "not generated", "not getting",
    "doesn't show", "does not show", "won't show", "will not show", "can't see", "cannot see", "unable to see", "no data", "missing",
    "blank", "empty", "stuck", "crash", "hang", "slow", "incorrect", "wrong", "mismatch", "duplicate",
]
SIMILAR_CUES = [
    "similar defect", "similar issue", "similar fixed", "like this", "related defect", "defects like", "comparable", "same kind of", "other defects",
    "previous defects", "similar to", "defects similar", "issues similar", "anything similar",
]
HELP_CUES = ["what can you do", "help", "who are you", "what are you", "how do you work", "capabilities", "hello", "hi ", "hey"]
TECHNICAL = r"(?i)\b(api|publish|sync|mapping|widget|dashboard|config|deploy|null|timeout|job|pipeline|asset|rule|eom|login|permission|integration|data|service|fault|case|error|fail|defect|bug)\b"

FLAG_TERMS = r"(?i)feature\s+flag|flag\s+name|enable\s+at\s+(org|site|user)\s+level|org\s+level|site\s+level|user\s+level|baseline\s+app\s+vis|cem\s+navigation|utility\s+data\s+tab|enablement|cemsEnable|cems\w+"
MATRIX_TERMS = r"(?i)energy\s+widget|carbon\s+widget|eo\s+widget|user\s+feature\s+flag|coexist\s+(feature\s+)?flag|energy\s+default\s+baseline|eo\s+default\s+baseline|data\s+from\s+old|data\s+from\s+new\s+baseline|new\s+baseline\s+data|no\s+data"
TEXT_TERMS = r"(?i)what\s+are\s+the\s+(?:\w+\s+){0,6}steps|how\s+(can|do|to|should)|explain|describe|what\s+should\s+(users?|i)|procedure|process|upload|download|create|update|verify|configure|cleansing|consumption\s+data|first\s+month|ingestion|\bsteps\s+(include|for|to|in)\b|\bonboarding\s+steps\b"
TABLE_TERMS = r"(?i)full\s+table|entire\s+table|whole\s+table|complete\s+table|show\s+(me\s+)?the\s+table|all\s+rows|every\s+row|summarize\s+the\s+(matrix|table)|what\s+(columns?|fields?)|list\s+(all|every)\s+.{0,30}(row|entry|option)"
CONDITIONS = [
    (r"(?i)user\s+feature\s+flag\s+(is\s+|=\s*|:\s*)?(enabled?)", "user_feature_flag", "Enabled"),
    (r"(?i)user\s+feature\s+flag\s+(is\s+|=\s*|:\s*)?(disabled?)", "user_feature_flag", "Disabled"),
    (r"(?i)coexist\s+(feature\s+)?flag\s+(is\s+|=\s*|:\s*)?(enabled?)", "coexist_feature_flag", "Enabled"),
    (r"(?i)coexist\s+(feature\s+)?flag\s+(is\s+|=\s*|:\s*)?(disabled?)", "coexist_feature_flag", "Disabled"),
    (r"(?i)energy\s+default\s+baseline\s+(is\s+|=\s*|:\s*)?(yes)", "energy_default_baseline", "Yes"),
    (r"(?i)energy\s+default\s+baseline\s+(is\s+|=\s*|:\s*)?(no)", "energy_default_baseline", "No"),
    (r"(?i)eo\s+default\s+baseline\s+(is\s+|=\s*|:\s*)?(yes)", "eo_default_baseline", "Yes"),
    (r"(?i)eo\s+default\s+baseline\s+(is\s+|=\s*|:\s*)?(no)", "eo_default_baseline", "No"),
]
REQUIRED_CONDITIONS = ["coexist_feature_flag", "energy_default_baseline", "eo_default_baseline", "user_feature_flag"]

MATRIX_SECTION_WORDS = ["visualiz", "widget", "dashboard", "coexist", "eo widget", "energy widget", "carbon widget"]
MATRIX_HEADER_WORDS = ["energy widget", "carbon widget", "eo widget", "coexist", "energy default", "eo default"]
FLAG_SECTION_WORDS = ["feature flag", "flag option", "enable flag"]
FLAG_HEADER_WORDS = ["flag", "applicable", "org level", "site level", "user level", "product", "enablement"]
SCREENSHOT_WORDS = [
    "browse dbfs", "upload data to dbfs", "copy system guid", "provisioning status", "drag and drop", "cancel", "select catalog", "workspace", "marketplace",
    "sql editor", "sql warehouses", "data engineering", "playground", "job runs", "compute", "items per page", "go to page",
]
FILE_BROWSER_WORDS = ["file size", "date of upload", "provisioned", "copy path", "spark api format", "file api format"]

NO_ANSWER_PHRASES = [
    "does not specify", "does not contain", "does not mention", "does not include", "does not provide", "does not describe", "does not cover", "does not address",
    "no relevant information", "no information is available", "no information was found", "not specified in the document", "not mentioned in the document",
    "not covered in the document", "not available in the document", "not found in the document", "could not find any information",
    "could not find relevant information", "unable to find any information", "unable to find relevant information",
]
NO_SOLUTION = "The documentation does not contain a solution for this."

FILLERS = [
    r"^(can you (please )?|could you (please )?|please |kindly )",
    r"^(i (was |am )?wondering (if |about |what |how )?)",
    r"^(i need to know |i want to know |i would like to know )",
    r"^(tell me (about |what |how )?)",
    r"^(explain (to me )?(what |how |why )?)",
    r"^(um+[,\s]*|uh+[,\s]*|so[,\s]+|like[,\s]+)",
    r"^(hey[,\s]+|hi[,\s]+|hello[,\s]+)",
]
CONTRACTIONS = {
    "don't": "do not", "doesn't": "does not", "didn't": "did not", "won't": "will not", "can't": "cannot", "shouldn't": "should not", "wouldn't": "would not",
    "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not", "I'm": "I am", "I've": "I have", "I'd": "I would", "I'll": "I will",
    "it's": "it is", "that's": "that is", "there's": "there is", "what's": "what is", "where's": "where is", "how's": "how is", "who's": "who is",
    "they're": "they are", "we're": "we are", "you're": "you are", "they've": "they have", "we've": "we have",
}

WEIGHT_SEMANTIC, WEIGHT_KEYWORD, WEIGHT_METADATA, WEIGHT_QUALITY, WEIGHT_FIXED, CANCELLED_PENALTY = 0.45, 0.25, 0.15, 0.10, 0.05, 0.15
CANDIDATES, FILTER_TOKENS, TOP_K, FLOOR, MARGIN = 60, 8, 8, 0.45, 0.75
K1, B, RRF = 1.5, 0.75, 60
CHUNK_TYPES = ["problem_chunk", "root_cause_chunk", "fix_chunk", "comment_insight_chunk", "full_context_chunk"]
SECTION_LIMIT, PART_SIZE, PART_OVERLAP, SEPARATORS = 3500, 1200, 200, ["\n\n", "\n", ". ", " ", ""]
# --- end of fixed values ------------------------------------------------------------------------------
