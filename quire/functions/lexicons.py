"""Word lists and patterns that results depend on."""

# Fixed values -----------------------------------------------------------------

#: Identifiers masked in this order: NNN-NN-NNNN, NN-NNNNNNN, eight digits and more, e-mail, phone.
MASK_PATTERNS = (
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{2}-\d{7}\b",
    r"\b\d{8,}\b",
    r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
)
MASK = "[REDACTED]"

#: Lines of faxes, bills, affidavits and instructions.
NOISE_LINES = (
    r"^\s*(?:fax|facsimile)\s*[:\-].*$",
    r"^\s*(?:to|from)\s*[:\-].*$",
    r"\bpage(?:\s+|:\s*)\d+(?:\s+of\s+\d+)?\b.*$",
    r"\b(?:cpt|icd[- ]?\d*)\b.*$",
    r"\bprocedure\s+code[: ]?\w+.*$",
    r"\b(?:billed|billing|charges?|ledger|invoice|statement\s+covers\s+period|amount\s+due)\b.*$",
    r"\b(?:payer|health\s+plan\s+id|group\s+no\.?|claim\s+no\.?|account\s+no\.?)\b.*$",
    r"\b(?:timestamps?|generated on|scanned on)\b.*$",
    r"\b(?:npi|mrn|acct#?)\b.*$",
    r"\b(?:affidavit|notary|custodian|commission\s+expires|state\s+of|county\s+of|sworn|regular\s+course\s+of\s+business|original\s+or\s+duplicate)\b.*$",
    r"\b(?:true\s+and\s+correct\s+copy|attached\s+hereto)\b.*$",
    r"\b(?:follow\s+(?:the\s+)?instructions\s+from\s+your\s+(?:health\s*care|healthcare)\s+provider)\b.*$",
    r"\b(?:seek\s+immediate\s+medical\s+attention|go\s+to\s+(?:the\s+)?nearest\s+emergency\s+department|call\s+911)\b.*$",
    r"\b(?:do\s+not\s+(?:drive|operate\s+heavy\s+machinery))\b.*$",
    r"\b(?:signs?\s+of\s+infection(?:\s+(?:fever|chills|redness|swelling|warmth|drainage))?)\b.*$",
    r"\b(?:nearest\s+emergency\s+department)\b",
)
TABLE_RULES = r"[│║╚═╦╩╣╠┼┤├┐└┘┌─]+"

PLACEHOLDER = r"(?i)^(?:n/?a|none(?:\s+(?:noted|reported|recorded))?|no data|empty|tbd|not (?:applicable|documented|provided)|nil)$"
SECTION_PLACEHOLDERS = (
    "n/a", "na", "no data", "none", "empty", "tbd",
    "not provided", "not documented", "provider not documented", "not listed", "no diagnoses documented", "no medications or prescriptions recorded",
)
#: Rewrites of empty words, in this order.
KEYWORD_REWRITES = (
    (r"(?i)\bN/?A\b", "not provided"),
    (r"(?i)\bno data\b", "not documented"),
    (r"(?i)\bempty\b", "not documented"),
    (r"(?i)\bTBD\b", "to be determined"),
    (r"(?i)\bnone\b", "not noted"),
)
LEGAL_PHRASES = (
    "recover from any third party", "fees and expenses", "i or any agent or representative", "i understand that", "this authorization is valid", "i hereby", "i acknowledge",
    "i have read and understand", "legal representation", "financial responsibility", "assignment of benefits", "release of information", "hipaa authorization", "hold harmless",
    "attorney", "law firm", "there are risks and hazards", "risks and hazards", "risks associated with", "prior treatment for this injury", "activities increase pain",
    "temporary localized increase in pain", "life threatening emergency", "these are your discharge instructions", "patient education materials", "patient education notes",
    "return to your normal activities", "educated on care of site", "fluoroscopy is used in the procedure", "nerve blocks and/or ablations", "no heavy lifting",
    "the patient was treated today", "patient activity restrictions", "discharge instructions", "call the office immediately", "go to an emergency room", "call 911",
    "potential for additional necessary care", "order status", "department status", "follow-up evaluation date", "worker's comp", "to treat my condition", "i consent to",
    "diabetes medicines or blood thinners",
)
WARNING_PHRASES = (
    "this is especially important if you are taking diabetes medicines or blood thinners", "i understand that the following treatment",
    "i understand that the following procedure", "i understand that there are risks", "i consent to the procedure",
)
UNWANTED_TOKENS = (
    "affiant", "notary", "ledger", "account", "charges", "billing", "invoice", "records", "affidavit", "incorporated", "commission", "financial", "statement", "balance",
    "acknowledge", "contractual", "responsible", "responsibility", "authorization", "authorize", "third party", "payment", "assign", "assignment", "lien", "legal", "consent",
    "release", "attorney", "representative", "liability", "indemnify", "hipaa", "settlement", "benefits", "insurance", "fees", "expenses", "witness", "sworn",
)
CONSENT_LINE = r"(?i)^\s*(?:i\s+(?:understand|authorize|consent)|to\s+treat\s+my\s+condition)\b"
REASON_ONLY_LINE = r"(?i)^\s*reason(?:s)?\s*for\s*visit\s*[:\-]?\s*$"
REASON_PREFIX = r"(?i)^\s*(?:reason(?:s)?\s+for\s+visit|chief\s+complaint)\s*[:\-]?\s*"
HEADING_ONLY = r"^\s*(?:[-*]\s*)?[A-Za-z][A-Za-z0-9 /&()'-]{0,80}:\s*$"
REPEATED_MARKERS = r"(?i)(?:^|\n)\s*(?:patient name|medical record number|medical record #|date of visit|dob|date of birth)\s*:"
VITAL_TOKENS = ("bp", "blood pressure", "pulse", "heart rate", "hr", "temp", "temperature", "rr", "resp", "spo2", "o2", "oxygen", "sat")
VITALS = {
    "blood_pressure": r"(?i)\b(?:blood\s+pressure|bp)\b\s*[:\-=]?\s*(\d{2,3}/\d{2,3})\b",
    "heart_rate": r"(?i)\b(?:heart\s+rate|pulse|hr)\b\s*[:\-=]?\s*(\d{2,3})\b",
    "resp_rate": r"(?i)\b(?:resp(?:iratory)?\s+rate|rr)\b\s*[:\-=]?\s*(\d{1,2})\b",
    "temperature": r"(?i)\b(?:temp(?:erature)?)\b\s*[:\-=]?\s*(\d{2,3}(?:\.\d+)?)\s*([CF]|°F|°C)?\b",
    "spo2": r"(?i)\b(?:spo2|o2\s*(?:sat|saturation))\b\s*[:\-=]?\s*(\d{2,3})%?\b",
}
DIAGNOSES = (
    (r"(?i)\blumbar\s+(?:disc|discopathy|radiculopathy)\b", "Lumbar discopathy"),
    (r"(?i)\bcervical\s+(?:disc|discopathy|radiculopathy)\b", "Cervical discopathy"),
    (r"(?i)\bthoracic\s+(?:disc|discopathy|radiculopathy)\b", "Thoracic discopathy"),
    (r"(?i)\bneck\s+pain\b", "Neck pain"),
    (r"(?i)\bback\s+pain\b", "Back pain"),
    (r"(?i)\bjoint\s+pain\b", "Joint pain"),
)
STOPWORDS = tuple("the and or of to a in for on with at by is are was were be this that from as an it patient patients medical summary plan follow diagnosis".split())
PAGE_STOPWORDS = tuple(
    "the and or of to a in for on with at by is are was were be this that from as an it patient date birth page admit disch mrn fin visit chart acct self established new".split()
)
HEADINGS = (
    ("provider_seen", "Provider Seen"), ("reason_for_visit", "Reason for Visit"), ("clinical_findings", "Clinical Findings"), ("treatment_follow_up_plan", "Treatment / Follow-up Plan"),
    ("diagnoses", "Diagnoses"), ("healthcare_providers", "Healthcare Providers"), ("medications", "Medications / Prescriptions"),
)

#: Page selection.
PAGE_HARD_REJECT = (
    "medical records affidavit", "affidavit of billing records", "affidavit of records by custodian", "authorization to disclose protected health information", "itemized statement",
    "power of attorney", "risk of non-treatment", "does not guarantee result or a cure", "access your visit summary", "pay your bill online", "get x-ray & lab results",
    "check your injection site every day", "ask your health care provider what steps will be taken to help prevent infection", "i have been given an opportunity to ask questions",
    "medication agreement", "state of texas",
)
PAGE_ADMIN = (
    "affidavit", "billing", "invoice", "ledger", "attorney", "authorization", "consent", "discharge", "instruction", "hipaa", "medical records", "custodian", "order status",
    "department status", "doctor cosign", "nurse review", "risk ", "hazard", "power of attorney", "release of information", "call 911", "emergency room", "medication agreement", "state of texas",
)
PAGE_CLINICAL = (
    "history of present illness", "reason for visit", "chief complaint", "assessment", "impression", "diagnosis", "plan", "follow-up", "follow up", "exam", "pain", "lumbar", "cervical",
    "ankle", "hand/finger", "neck", "medication", "prescription", " mg", "blood pressure", "mri", "x-ray", "xray", "ct ", "provider", "dr.", "presents for", "radiculopathy", "strain", "sprain",
)
PAGE_ADMIN_PAIRS = (
    ("pharmacy", "order status"), ("pharmacy", "department status"), ("doctor cosign", "order status"), ("nurse review", "doctor cosign"), ("misc nursing task", "pacu"), ("call 911", "emergency room"),
)
PAGE_HEADER_NOISE = (
    "account information", "practice information", "report request id", "print date/time", "to:", "from:", "page:", "acct #:", "auth (verified)", "fax:", "e&m code", "cpt",
)
PAGE_METADATA = ("patient:", "date of birth", "acct #:", "mrn:")

#: Quality of structured summaries.
SUMMARY_ADMIN_PHRASES = (
    "authorize my physicians", "authorization to disclose protected health information", "doctor cosign", "nurse review", "order status", "department status", "discharge instructions",
    "call 911", "emergency room", "risk of non-treatment", "does not guarantee result or a cure", "medical records affidavit", "power of attorney", "check your injection site every day",
    "keep an active list of medications", "final active medications list", "medication agreement", "please fill your prescriptions", "release of information",
)
SUMMARY_ADMIN_TOKENS = (
    "affidavit", "authorization", "consent", "billing", "invoice", "ledger", "attorney", "discharge", "instruction", "instructions", "cosign", "review", "department", "status",
    "pharmacy", "hazard", "hipaa", "records",
)
CLINICAL_TOKENS = (
    "pain", "injury", "lumbar", "cervical", "ankle", "neck", "exam", "assessment", "diagnosis", "plan", "follow", "medication", "prescription", "imaging", "mri", "xray", "fracture",
    "sprain", "strain",
)
QUALITY_SLUGS = ("provider_seen", "reason_for_visit", "clinical_findings", "treatment_follow_up_plan", "diagnoses", "medications")
REASON_TOKENS = ("visit", "follow", "followup", "follow-up", "pain", "injury", "complaint", "symptom", "evaluation", "presents", "presented", "chief", "history")
REASON_ADMIN = ("doctor cosign", "nurse review", "please fill your prescriptions", "authorize my physicians", "keep an active list of medications")
PROVIDER_HINT = r"(?i)\b(?:dr\.?\s+[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,3}|physician|provider|nurse practitioner|physician assistant|pa-c|np|m\.d\.|d\.o\.)\b"
MEDICATION_HINT = (
    r"(?i)\b(?:[A-Z][a-z]{3,}(?:\s+[A-Z][a-z]{3,})*\s+\d+\s*(?:mg|mcg|g|ml)|\d+\s*(?:mg|mcg|g|ml)|tablet|capsule|patch|ointment|injection"
    r"|ibuprofen|acetaminophen|cyclobenzaprine|lisinopril|hydromorphone|labetalol)\b"
)
DIAGNOSIS_HINT = r"(?i)\b(?:[A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]+)?|pain|strain|sprain|fracture|radiculopathy|hypertension|diabetes|migraine|injury|syndrome|disease|arthritis|contusion|spasm)\b"
#: Degrees of which the dots end no sentence, by their parts.
DEGREES = (r"(?i)\b(M)\.(D)\.\b", r"(?i)\b(D)\.(O)\.\b", r"(?i)\b(P)\.(A-C)\.\b", r"(?i)\b(P)\.(A)\.\b", r"(?i)\b(N)\.(P)\.\b")
HEADER_TOKENS = ("diagnoses:", "clinical findings:", "treatment", "medications", "reason for visit:", "provider seen:")
INVALID_KEYWORDS = ("n/a", "no data", "none", "empty", "tbd")
#: Phrases that no line of a finished summary may hold.
FINAL_NOISE = (
    "temporary localized increase in pain", "fever, facial flushing", "call the office immediately", "emergency room", "patient education", "discharge instructions", "no heavy lifting",
    "facet injections are mostly a diagnostic tool", "medial branch blocks are spinal injections", "i retain the right to refuse", "plan of care (continued)", "thank you for choosing",
    "return to your normal activities", "instructions, prescriptions", "educated on care of site", "workers comp", "potential for additional necessary care", "order status",
    "department status", "follow-up evaluation date",
)
