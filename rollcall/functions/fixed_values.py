"""Values that results depend on.

Everything in this file is a fixed value: a word list, host list, label, pattern or
constant that has to be exactly this for results to agree. No logic lives here.
"""

# --- fixed values: e-mail -------------------------------------------------------------
PERSONAL_DOMAINS = [
    "gmail.com", "hotmail.com", "yahoo.com", "outlook.com", "me.com",
    "icloud.com", "aol.com", "protonmail.com", "proton.me", "msn.com",
    "live.com", "mail.com", "ymail.com", "zoho.com", "hey.com", "pm.me",
]
# Subset that blocks the strong own-domain grade of search evidence.
UNGRADED_DOMAINS = [
    "gmail.com", "hotmail.com", "yahoo.com", "outlook.com", "me.com",
    "icloud.com", "aol.com", "proton.me", "protonmail.com", "msn.com",
    "live.com", "hey.com", "pm.me",
]
GENERIC_MAILBOXES = ["info", "admin", "contact", "hello", "office", "support", "mail"]

# --- fixed values: hosts --------------------------------------------------------------
BROKER_HOSTS = [
    "spokeo.com", "beenverified.com", "whitepages.com", "radaris.com",
    "truepeoplesearch.com", "peekyou.com", "rocketreach.com", "clearbit.com",
    "zoominfo.com", "apollo.io", "contactout.com", "signalhire.com",
    "lusha.com", "hunter.io", "snov.io", "skrapp.io", "uplead.com",
    "leadiq.com", "seamless.ai", "nymeria.io",
]
OPEN_WEB_BLOCKED_HOSTS = BROKER_HOSTS + ["mylife.com"]
# Substrings that keep a result out of the captured evidence.
CAPTURE_BLOCKED = [
    "spokeo.com", "beenverified", "whitepages", "radaris", "truepeoplesearch",
    "peekyou", "rocketreach", "clearbit", "zoominfo", "apollo.io",
]
TITLE_BROKER_HOSTS = [
    "contactout.com", "rocketreach.com", "signalhire.com", "lusha.com",
    "apollo.io", "hunter.io", "zoominfo.com", "leadiq.com",
]
TITLE_BROKER_WORDS = [
    "ContactOut", "RocketReach", "SignalHire", "Lusha",
    "Apollo", "Hunter", "ZoomInfo", "LeadIQ",
]
HARVEST_SKIP_HOSTS = [
    "google.com", "docs.google.com", "drive.google.com", "youtube.com", "youtu.be",
    "facebook.com", "instagram.com", "wikipedia.org",
]
MERGED_FIELD_HOSTS = ["linkedin", "twitter", "x", "github", "substack", "medium"]
RESERVED_HANDLES = ["search", "explore", "home", "settings", "i", "intent"]

# --- fixed values: names and organisations ---------------------------------------------
COMMON_FIRST_NAMES = [
    "james", "john", "robert", "michael", "david", "william", "richard", "joseph",
    "thomas", "charles", "mary", "patricia", "jennifer", "linda", "elizabeth",
    "sarah", "jessica", "susan", "margaret", "alice", "jane", "alex", "bob",
    "wei", "yuki", "priya", "anil", "elena", "marcus", "diana", "rachel",
    "tom", "mark", "dr", "col", "lt", "gen", "prof",
]
CREDENTIAL_TOKENS = [
    "jr", "sr", "ii", "iii", "iv", "phd", "md", "esq", "mba", "mph", "dphil",
    "ma", "ms", "bs", "ba", "jd", "ph", "d", "m",
]
SUFFIX_TOKENS = ["jr", "sr", "ii", "iii", "iv", "phd", "ph", "md", "dr", "esq"]
NAME_TITLE_PATTERN = r"(?i)\b(dr|prof|mr|mrs|ms|sir|col|lt|gen|ret|jr|sr|iii?|iv)\b\.?"
ORG_NOISE_PATTERN = r"(?i)\b(inc|llc|ltd|corp|co|company|the|of|for)\b\.?"
CREDENTIAL_TAIL_PATTERN = (
    r"(?i),?\s*\b(ph\.?\s*d\.?|m\.?\s*d\.?|j\.?\s*d\.?|d\.?\s*phil\.?|"
    r"esq\.?|mba|mph|ma|ms|ba|bs|jr\.?|sr\.?|iii|iv|ii)\b\.?\s*$"
)
AUDIT_CREDENTIAL_PATTERN = (
    r"(?i),?\s*\b(ph\s*\.?\s*d\.?|m\s*\.?\s*d\.?|j\s*\.?\s*d\.?|d\s*\.?\s*phil\.?|"
    r"esq\.?|cpa|cfa|cfp|clu|chfc|ricp|pmp|mba|mph|msw|mfa|ma|ms|bs|ba|"
    r"jr\.?|sr\.?|ii|iii|iv|reg\.?|rn|np|lcsw|pe|aia|pharmd)\b\.?"
)
VERIFY_SUFFIX_PATTERN = r"(?i),?\s*(ph\.?d\.?|mpa|mba|m\.?d\.?|jr\.?|sr\.?|iii?|iv)$"
VAGUE_ORGS = [
    "n/a", "self-employed", "self employed", "freelance", "independent", "stealth",
    "stealth startup", "none", "na", "personal", "",
]
VAGUE_ORG_STARTS = ["stealth", "new ", "my ", "own ", "various", "startup"]
BLANK_WORDS = ["NA", "N/A", "NONE"]

# --- fixed values: content words ---------------------------------------------------------
KEYWORD_STOPWORDS = [
    "this", "that", "with", "from", "have", "been", "they", "their", "will", "would",
    "could", "should", "about", "which", "there", "these", "those", "into", "also",
    "more", "most", "some", "such", "than", "then", "when", "what", "your", "very",
    "just", "like", "make", "made", "know", "need", "want", "work", "well", "back",
    "only", "come", "each", "over", "other", "after", "before", "being", "between",
    "through", "during", "without", "within", "across", "hope", "learn", "various",
    "based", "skills", "people", "world", "improving", "plan", "event", "looking",
    "interested", "help", "working", "using", "order", "believe", "having", "focus",
    "currently", "completed", "online", "training", "program",
]
OVERLAP_STOPWORDS = [
    "about", "their", "these", "those", "would", "could", "should", "being", "other",
    "which", "through", "between", "before", "after",
]
BOILERPLATE_STARTS = ["Cookie", "Privacy", "Terms", "Copyright", "©"]

# --- fixed values: column typing -----------------------------------------------------------
COLUMN_PATTERNS = [
    (r"(?i)(full.?name|first.?name|last.?name|given.?name|family.?name|^name$|^person$|^candidate$|contact.?name|^attendee$|^participant$|^respondent$|^applicant$|^member$|^speaker$|^panelist$|^author$)", "identity_name"),
    (r"(?i)(e[-.]?mail|email.?address)", "identity_email"),
    (r"(?i)(linkedin|li.?url|li.?profile|linkedin.?url|linkedin.?profile)", "identity_linkedin"),
    (r"(?i)(company|org|organization|employer|firm|institution)", "identity_org"),
    (r"(?i)(^title$|job.?title|^role$|^position$|designation|- title$)", "identity_title"),
    (r"(?i)(phone|mobile|cell|tel)", "identity_phone"),
    (r"(?i)(twitter|x\.com|x account|x profile|x handle)", "link_twitter"),
    (r"(?i)(website|personal.?site|homepage|url|web.?page)", "link_website"),
    (r"(?i)(resume|cv|curriculum.?vitae|gdrive|google.?drive)", "link_resume"),
    (r"(?i)(github|gitlab|portfolio)", "link_other"),
    (r"(?i)^(id|_id|row.?id|record.?id|uuid|index|#)$", "ignore"),
    (r"(?i)^(created|updated|modified|timestamp|date.?added|imported)(.?at|.?on|.?date)?$", "ignore"),
    (r"(?i)(tag|label|category|type|status|stage|source|location|city|state|country|region)", "metadata"),
    (r"(?i)(date|year|score|rating|rank|priority|tier)", "metadata"),
    (r"(?i)(notes?|transcript|call.?notes?|meeting.?notes?|interview|comments?|description|bio|about|summary|pitch|narrative|observations?|assessment|evaluation|recommendation|review)", "content"),
]
FIELD_TIERS = [
    (r"(?i)(call.?notes?|meeting.?notes?|interview|transcript|conversation|debrief|1.?on.?1)", "first_person"),
    (r"(?i)(assessment|evaluation|recommendation|review|reference|endorsement)", "expert_assessment"),
    (r"(?i)(linkedin|experience|education|profile)", "linkedin"),
    (r"(?i)(pitch|bio|about|description|summary|essay|proposal|statement|solution|problem|motivation|application)", "self_reported"),
]
TIER_PRIORITY = {"first_person": 0, "expert_assessment": 1, "linkedin": 2, "self_reported": 3}
SHORT_TEXT, MEDIUM_TEXT, LONG_TEXT = 200, 600, 1500
FIELD_PRIORITY = [
    "linkedin", "author_assessment", "recommendations", "pitch", "problem", "solution",
    "uncertainties",
]

# --- fixed values: log lines ----------------------------------------------------------------
LOG_PATTERNS = [
    ("search_query", "Search ("),
    ("trying_linkedin", "Trying LinkedIn"),
    ("verify_accepted", "Verify result: ACCEPTED"),
    ("verify_rejected", "Verify result: REJECTED"),
    ("weak_match_rejected", "WEAK-MATCH REJECTED"),
    ("org_mismatch", "Verify org: MISMATCH"),
    ("org_mismatch_generic", "MISMATCH"),
    ("no_linkedin_found", "No LinkedIn profile found"),
    ("verification_failed", "verification failed"),
    ("out_of_credits", "Out of API credits"),
    ("out_of_credits_alt", "OUT_OF_CREDITS"),
    ("enrichlayer_error", "LinkedIn enrichment failed"),
]
FAILURE_PATTERNS = [
    ("REJECTED (soft penalty without corroborating", "soft_penalty_no_positive"),
    ("REJECTED (weak name match with no corroborating", "weak_name_no_positive"),
    ("WEAK-MATCH REJECTED", "weak_match_hard_reject"),
    ("Verify name: MISMATCH", "name_mismatch"),
    ("Verify org: MISMATCH", "org_mismatch"),
    ("Verify location: MISMATCH", "location_mismatch"),
    ("Verify content relevance: WEAK", "content_weak"),
    ("Ambiguous:", "ambiguous_tie"),
    ("No LinkedIn profile found", "no_linkedin_found"),
    ("Best match too weak", "score_below_threshold"),
    ("API returned no data", "api_no_data"),
    ("LinkedIn enrichment failed", "enrichlayer_error"),
    ("Out of API credits", "out_of_credits"),
]
REASON_CATEGORIES = [
    ("score_below_threshold", "score_below_threshold"),
    ("weak_name_no_corroboration", "weak_name_no_corroboration"),
    ("soft_penalty_no_positive", "soft_penalty_no_positive"),
    ("weak name match rejected (short-token-only)", "weak_match_short_token"),
    ("weak name match rejected (last-name-missing)", "weak_match_last_name_missing"),
    ("name mismatch", "name_mismatch"),
    ("accepted", "accepted"),
    ("arbiter selected", "arbiter_selected"),
    ("arbiter abstained", "arbiter_abstained"),
    ("arbiter rejected", "arbiter_rejected"),
]

# --- fixed values: evidence, decisions, prices -----------------------------------------------
ANCHOR_TYPES = [
    "bio_match", "email_match", "literal_email", "name_match", "platform_match", "slug_match",
]
DISTINGUISHING_SIGNALS = [
    "org-exact", "org-words", "email-evidence", "slug=email", "title-exact", "loc-city",
    "loc-country",
]
TRANSIENT_REASONS = [
    "empty_body", "transient_exhausted", "5xx_persisted", "429_rate_limited_exhausted",
    "json_parse_error",
]
STATUSES = ["pending", "enriched", "failed", "skipped"]
SEARCH_PRICE, VENDOR_PRICE = 0.006, 0.0168
MAX_EXEMPLARS = 10
CARD_CHARS = 3000
