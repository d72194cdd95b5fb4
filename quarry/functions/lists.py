"""Word lists, patterns and prices that results depend on."""

# fixed values: words that carry no content in answers
CONTENT_STOP = "the a an is are was were be been being have has had do does did will would could should may might can shall in on at to for of with by from and or but not no if then so as that this it its they their them we our you your i my me he she his her what which who where when how why".split()

# fixed values: words that sparse vectors leave out
SPARSE_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

# fixed values: words that tell the kind of a query
STRUCTURED = "section chapter table figure appendix page heading paragraph summary conclusion introduction abstract findings recommendation".split()
FACTUAL = ["compare", "across", "all documents", "every", "between", "list all", "how many", "what is", "define", "who"]
MULTI_HOP = "compare contrast relationship between versus vs".split()
INVOLVED = "why how explain analyze evaluate synthesize".split()

# fixed values: personal data, in the order in which it is redacted
PII = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone_us": r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "passport": r"\b(?:[A-Z]{1,2}\d{6,9}|\d{9})\b",
    "date_of_birth": r"(?i)\b(?:DOB|Date of Birth|Born)[:\s]+\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b",
    "drivers_license": r"(?i)\b(?:DL|Driver'?s?\s*(?:License|Licence))[:\s#]+[A-Z]?\d{6,14}\b",
    "medical_record": r"(?i)\b(?:MRN|Medical Record)[:\s#]+\d{6,10}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]?){0,16}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "aws_access_key": r"\b(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}\b",
    "aws_secret_key": r"(?i)aws_secret_access_key\s*=\s*\S{40}",
    "aws_arn": r"\barn:aws:[a-z0-9\-]+:[a-z0-9\-]*:\d{12}:[^\s]+\b",
    "api_key_generic": r"(?i)\b(?:api[_-]?key|token|secret)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{32,}['\"]?",
}

# fixed values: what queries must not ask for, and answers must not say
INJECTION = [
    r"ignore\s+(?:previous|all|above)\s+instructions",
    r"system\s*prompt",
    r"you\s+are\s+now",
    r"reveal\s+(?:your|the)\s+(?:system|initial)",
    r"<\s*script",
    r"(?:DROP|DELETE|TRUNCATE)\s+TABLE",
    r"UNION\s+SELECT",
]
LEAKS = [r"as\s+an\s+ai\s+(?:language\s+)?model", r"I\s+(?:cannot|can't)\s+access"]

# fixed values: SQL that read-only tools refuse
WRITES = "DROP DELETE UPDATE INSERT TRUNCATE ALTER CREATE GRANT REVOKE EXEC EXECUTE MERGE".split()
READS = "SELECT WITH EXPLAIN DESCRIBE SHOW".split()
UNSAFE_SQL = [r"--", r"/\*", r";\s*\w", r"(?i)'\s*OR\s+'", r"(?i)UNION\s+SELECT", r"(?i)xp_\w+"]

# fixed values: characters that text cleaning replaces
QUOTES = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2026": "...", "\u00a0": " ", "\u200b": "", "\ufeff": ""}

# fixed values: ligatures and furniture of page layouts
LIGATURES = {"\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
BOILERPLATE = [r"^\d+$", r"^Page \d+$", r"^Page \d+ of \d+$", r"CONFIDENTIAL", r"DO NOT DISCLOSE", r"INTERNAL USE ONLY"]

# fixed values: what answers without or with weak sources say
NO_SOURCES = "I could not find relevant sources to answer this question confidently. Try rephrasing your query or uploading additional documents."
LOW_CONFIDENCE = ("\u26a0\ufe0f Low confidence (", "): ", "\n\nThe retrieved documents may not be highly relevant to your question.")

#: Function words of other languages, chosen here for sparse vectors.
STOP_BY_LANG = {
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht oder sie sich sind so und von vor war wie wir zu zum zur".split(),
    "fr": "à au aux avec ce ces dans de des du elle en et il ils je la le les leur lui mais me ne nous on ou où par pas pour qu que qui sa se ses son sur un une vous".split(),
    "es": "a al como con de del el ella en entre es esta este ha la las lo los más me mi no o para pero por que se sin sobre su sus un una y ya".split(),
}

# fixed values: tokens a day by tier, and dollars per million tokens in and out by model
DAILY_TOKENS = {"free": 50_000, "standard": 200_000, "pro": 500_000, "premium": 2_000_000, "enterprise": 5_000_000}
PRICES = {"gpt-4o": (2.50, 10.0), "gpt-4o-mini": (0.15, 0.60), "gpt-4-turbo": (10.0, 30.0), "claude-3-5-sonnet": (3.0, 15.0), "claude-3-haiku": (0.25, 1.25), "noop-llm-v1": (0.0, 0.0)}
OTHER_PRICE = (5.0, 15.0)
# fixed values: what the stand-in for a model answers
STAND_IN = ("Based on the provided sources, here is what I found:\n\n", "\n\nThis answer was generated from ", " source(s) in response to: ")
NO_CONTEXT = "No relevant context was provided. Please ensure documents have been uploaded and indexed."

# fixed values: dollars per million tokens in and out by model, where usage is summed by model
MODEL_PRICES = {"amazon.titan-embed-text-v2:0": (0.02, 0.0), "text-embedding-3-small": (0.02, 0.0), "text-embedding-3-large": (0.13, 0.0), "anthropic.claude-3-5-sonnet-20241022-v2:0": (3.0, 15.0), "gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "noop-llm-v1": (0.0, 0.0)}
