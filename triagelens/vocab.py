"""Word lists, patterns, tables and constants that results depend on.

Regular expressions are written for java.util.regex; ``(?U)`` gives ``\\w``,
``\\d``, ``\\s`` and ``\\b`` their Unicode meaning.
"""

from __future__ import annotations

# -- text normalization -----------------------------------------------------

URL = r"(?iU)https?://\S+|www\.\S+"
HANDLE = r"(?U)@\w+"
HASHTAG = r"(?U)#(\w+)"
EMOJI = (
    "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}"
    "\\x{2702}-\\x{27B0}\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FA6F}\\x{1FA70}-\\x{1FAFF}\\x{2600}-\\x{26FF}]+"
)
MASK = r"(?i)__[a-z_]+__"
QUOTES = "['‘’“”`]"
REPEATS = r"(.)\1{3,}"

COLLOQUIAL = {
    "u": "you", "ur": "your", "r": "are", "pls": "please", "plz": "please", "thx": "thanks", "thanx": "thanks",
    "ty": "thank you", "bc": "because", "rn": "right now", "asap": "as soon as possible", "dm": "direct message",
    "msg": "message", "acct": "account", "pw": "password", "pwd": "password", "info": "information",
    "cust": "customer", "svc": "service", "mgr": "manager", "dept": "department", "amt": "amount",
    "qty": "quantity", "dlvry": "delivery", "addr": "address", "smth": "something", "smthing": "something",
}

TONE_EMPATHETIC = ["sorry", "apologize", "understand", "frustrating"]
TONE_PROFESSIONAL = ["please", "kindly", "verify", "confirm"]
SECTION_TERMS = [
    ("billing", ["refund", "charged", "billing", "invoice", "payment"]),
    ("accounts", ["password", "login", "account", "locked", "access"]),
    ("shipping", ["shipping", "delivery", "carrier", "package", "order"]),
    ("technical", ["error", "bug", "crash", "failed", "issue"]),
]
ASSISTANT_ROLES = ["agent", "assistant", "support", "system"]
CHAT_TAGS = ["refund", "login", "shipping", "error"]
SOCIAL_TAGS = ["refund", "delay", "shipping", "account", "password"]
CATEGORY_SECTIONS = {
    "ACCOUNT": "accounts", "ORDER": "shipping", "PAYMENT": "billing", "REFUND": "billing",
    "SHIPPING_ADDRESS": "shipping", "DELIVERY": "shipping", "INVOICE": "billing", "CANCELLATION_FEE": "billing",
    "FEEDBACK": "general", "NEWSLETTER": "general", "CONTACT": "general",
}

# -- personal data ----------------------------------------------------------

PII_PATTERNS: list[tuple[str, str, str]] = [
    (r"(?U)\b\d{3}[\s\-]?\d{2}[\s\-]?\d{4}\b", "{{SSN}}", "ssn"),
    (r"(?U)\b(?:\d[\s\-]?){13,19}\b", "{{Credit Card}}", "credit_card"),
    (r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b", "{{Email}}", "email"),
    (r"(?U)(?:\+?\d{1,3}[\s\-.]?)?\(?\d{2,4}\)?[\s\-.]?\d{3,4}[\s\-.]?\d{3,5}\b", "{{Phone Number}}", "phone"),
    (r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "{{IP Address}}", "ip_address"),
    (r"(?iU)\b(?:order|ord|ref|confirmation)[\s#:\-]+([A-Z0-9\-]*\d[A-Z0-9\-]{3,19})\b", "{{Order Number}}", "order_number"),
    (r"(?iU)\b(?:invoice|inv)[\s#:\-]+([A-Z0-9\-]*\d[A-Z0-9\-]{2,19})\b", "{{Invoice Number}}", "invoice_number"),
    (r"(?iU)\b(?:account|acct|acc)[\s#:\-]+([A-Z0-9\-]*\d[A-Z0-9\-]{2,19})\b", "{{Account ID}}", "account_id"),
    (r"(?iU)\b\d{1,6}\s+(?:[A-Z][a-z]+\s+){1,4}(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Ct|Court|Way|Pl|Place)\b",
     "{{Address}}", "address"),
    (r"(?U)\b(?:my name is|i am|this is|name:?)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", "{{Client Name}}", "client_name"),
    (r"(?iU)(?:\$|€|£|¥)\s?\d[\d,]*\.?\d{0,2}\b|\b\d[\d,]*\.?\d{0,2}\s?(?:USD|EUR|GBP|CAD|AUD)\b", "{{Money Amount}}", "money_amount"),
    (r"(?U)\b(?:\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{1,2}[/\-]\d{1,2})\b", "{{Date}}", "date"),
    (r"(?iU)https?://\S+|www\.\S+", "{{URL}}", "url"),
]
ENTITY_PLACEHOLDER = r"\{\{([^}]+)\}\}"

OUTPUT_PII: list[tuple[str, str]] = [
    ("email", r"(?i)[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}"),
    ("phone", r"(?U)\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("ssn", r"(?U)\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"(?U)\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("ip_address", r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("date_of_birth",
     r"(?U)\b(?:0[1-9]|1[0-2])[/\-](0[1-9]|[12]\d|3[01])[/\-](19|20)\d{2}\b"
     r"|\b(19|20)\d{2}[/\-](0[1-9]|1[0-2])[/\-](0[1-9]|[12]\d|3[01])\b"),
]
FORBIDDEN_OUTPUT: list[tuple[str, str]] = [
    ("system_prompt_leak", r"(?iU)(system\s+prompt|internal\s+instructions?|you\s+are\s+a\s+helpful)"),
    ("role_marker_leak", r"(?i)<\|im_start\|>|<\|im_end\|>|\[INST\]|<<SYS>>"),
    ("url_injection", r"(?iU)https?://(?!(?:support|help|docs|faq|status)\.\w+)"),
    ("markdown_injection", r"(?i)!\[.*?\]\(https?://.*?\)"),
]
REQUIRED_CITATION = r"(?U)\[chunk_\w+\]"
ANY_CITATION = r"(?U)\[[\w\-]+\]"
MIN_RESPONSE_LENGTH = 10
MAX_RESPONSE_LENGTH = 2000

# -- prompt injection -------------------------------------------------------

INJECTION_RULES: list[tuple[str, str]] = [
    ("instruction_override", r"(?iU)ignore\s+(?:all\s+)?(?:previous|above|prior)\s+(?:instructions?|rules?|prompts?)"),
    ("instruction_disregard",
     r"(?iU)disregard\s+(?:all\s+)?(?:previous|above|prior|your)\s+(?:instructions?|rules?|guidelines?|context)"),
    ("instruction_forget", r"(?iU)forget\s+(?:everything|all|what)\s+(?:you\s+)?(?:know|were\s+told|above)"),
    ("role_switch", r"(?iU)you\s+are\s+now\s+(?:a|an|the)\s+\w+"),
    ("role_impersonation", r"(?iU)act\s+as\s+(?:a|an|if)\s+"),
    ("role_pretend", r"(?iU)pretend\s+(?:you\s+are|to\s+be)\s+"),
    ("role_override", r"(?iU)from\s+now\s+on\s+you\s+(?:are|will|must|should)"),
    ("prompt_extraction",
     r"(?iU)(?:print|show|reveal|display|output|repeat)\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions?|rules?)"),
    ("prompt_query", r"(?iU)what\s+(?:are|is|were)\s+your\s+(?:system\s+)?(?:instructions?|rules?|prompt|guidelines?)"),
    ("exfiltration_attempt", r"(?iU)(?:send|post|fetch|curl|wget|http)\s+(?:to|from)\s+(?:https?://|[a-z]+\.)"),
    ("delimiter_injection", r"(?iU)```\s*(?:system|assistant|user)\s*\n"),
    ("chatml_injection", r"(?i)<\|(?:im_start|im_end|system|user|assistant)\|>"),
    ("llama_delimiter_injection", r"(?i)\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"),
    ("encoding_evasion", r"(?iU)(?:base64|b64)\s*(?:decode|encoded?)\s*[:=]"),
    ("jailbreak_dan", r"(?iU)(?:DAN|Do\s+Anything\s+Now)\s+(?:mode|prompt|jailbreak)"),
    ("jailbreak_mode", r"(?iU)(?:developer|debug|god|admin|root)\s+mode"),
]
ROLE_MARKER = r"(?imU)(?:^|\n)\s*(?:system|user|assistant|human|ai)\s*[:>]\s"
SENTENCE_BREAK = r"[.!?\n]+"
IMPERATIVE = (
    r"(?iU)^(?:you\s+(?:must|should|will|are|need)|do\s+not|don't|please\s+(?:ignore|forget|disregard)|"
    r"now\s+|always\s+|never\s+|stop\s+|start\s+)"
)
SUSPICIOUS_TOKENS = [
    "ignore", "disregard", "override", "bypass", "jailbreak", "roleplay", "pretend", "persona", "sudo", "admin",
    "system_prompt", "reveal", "instructions",
]

# -- routing and policy -----------------------------------------------------

ROUTES = [
    "refund_duplicate_charge", "account_access_recovery", "shipping_delay_resolution", "technical_bug_triage",
    "general_support_triage",
]
ROUTE_KEYWORDS = {
    "refund_duplicate_charge": ["charged twice", "duplicate", "refund", "double charge"],
    "account_access_recovery": ["password", "locked", "login", "reset"],
    "shipping_delay_resolution": ["shipping", "delay", "carrier", "delivery"],
    "technical_bug_triage": ["error", "bug", "crash", "failed"],
    "general_support_triage": ["help", "support", "question"],
}
ESCALATION_TERMS = [
    "fraud", "breach", "legal", "lawsuit", "security incident", "chargeback", "unauthorized", "stolen", "hacked",
    "identity theft", "data leak", "threatening", "harassment", "discrimination", "regulator", "attorney",
]
POLICY_TERMS = ["breach", "lawsuit", "fraud", "security incident", "legal threat"]
CONTRADICTIONS: list[tuple[str, str, float]] = [
    ("refund", "do not refund", 0.4), ("refund", "no refund", 0.35), ("refund", "non-refundable", 0.35),
    ("fraud", "safe to proceed", 0.4), ("fraud", "no fraud detected", 0.3), ("cancel", "cannot cancel", 0.3),
    ("cancel", "non-cancellable", 0.3), ("free", "additional fee", 0.25), ("discount", "not eligible", 0.25),
    ("urgent", "standard processing", 0.2), ("broken", "working as expected", 0.3), ("lost", "delivered", 0.3),
    ("overcharged", "correct amount", 0.3),
]
PREFERRED_TONES = ["formal", "professional", "concise", "empathetic", "friendly"]
UPSET_TERMS = ["angry", "frustrated", "upset", "cancel", "fraud", "stolen"]
PREMIUM_TIERS = ["enterprise", "vip", "premium"]
CHANNEL_STYLE = {  # channel: (length limit, format)
    "twitter": (280, "Single short paragraph. No bullet points. Use contractions."),
    "chat": (600, "Short paragraphs. One clear next-step call-to-action."),
    "email": (1500, "Greeting, context paragraph, numbered steps, closing."),
    "phone": (800, "Simple sentences. Avoid jargon. Summarise at end."),
}

# Default linear models: bias, token weights and calibration.
ROUTING_MODEL = {
    "labels": ROUTES,
    "bias": {
        "refund_duplicate_charge": 0.35, "account_access_recovery": 0.25, "shipping_delay_resolution": 0.25,
        "technical_bug_triage": 0.25, "general_support_triage": 0.15,
    },
    "token_weights": {
        "refund": {"refund_duplicate_charge": 2.3, "general_support_triage": 0.2},
        "charged": {"refund_duplicate_charge": 1.7}, "charge": {"refund_duplicate_charge": 1.2},
        "duplicate": {"refund_duplicate_charge": 1.8}, "twice": {"refund_duplicate_charge": 1.6},
        "billing": {"refund_duplicate_charge": 0.7},
        "password": {"account_access_recovery": 2.2}, "login": {"account_access_recovery": 1.8},
        "locked": {"account_access_recovery": 1.8}, "reset": {"account_access_recovery": 1.6},
        "access": {"account_access_recovery": 1.4}, "account": {"account_access_recovery": 1.0},
        "shipping": {"shipping_delay_resolution": 2.0}, "delay": {"shipping_delay_resolution": 2.1},
        "delivery": {"shipping_delay_resolution": 1.7}, "carrier": {"shipping_delay_resolution": 1.6},
        "package": {"shipping_delay_resolution": 1.2}, "tracking": {"shipping_delay_resolution": 1.1},
        "error": {"technical_bug_triage": 1.9}, "bug": {"technical_bug_triage": 2.1},
        "crash": {"technical_bug_triage": 2.0}, "failed": {"technical_bug_triage": 1.6},
        "failure": {"technical_bug_triage": 1.6}, "timeout": {"technical_bug_triage": 1.4},
        "help": {"general_support_triage": 1.2}, "support": {"general_support_triage": 1.2},
        "question": {"general_support_triage": 1.1}, "request": {"general_support_triage": 0.8},
        "assistance": {"general_support_triage": 1.0},
    },
}
ROUTING_CALIBRATION = {"temperature": 1.1, "min_probability": 0.01, "max_probability": 0.97}
ESCALATION_MODEL = {
    "bias": -2.1, "route_uncertainty_weight": 1.2, "evidence_gap_weight": 0.7, "long_word_ratio_weight": 0.4,
    "token_weights": {
        "fraud": 1.7, "breach": 1.7, "legal": 1.5, "lawsuit": 1.6, "chargeback": 1.3, "security": 1.2, "incident": 1.0,
        "threat": 1.0, "urgent": 0.5, "escalate": 0.8, "complaint": 0.4,
    },
}
ESCALATION_CALIBRATION = {"a": 1.05, "b": -0.02, "min_probability": 0.02, "max_probability": 0.98}

# -- intent taxonomy: id, category, risk level, escalation hint, keywords ---

INTENTS: list[tuple[str, str, str, float, list[str]]] = [
    ("create_account", "ACCOUNT", "low", 0.05, ["create account", "sign up", "register", "new account", "open account"]),
    ("delete_account", "ACCOUNT", "medium", 0.25, ["delete account", "close account", "remove account", "deactivate"]),
    ("edit_account", "ACCOUNT", "low", 0.05,
     ["edit account", "update account", "change details", "modify account", "update profile"]),
    ("switch_account", "ACCOUNT", "low", 0.05, ["switch account", "change account", "different account", "other account"]),
    ("recover_password", "ACCOUNT", "medium", 0.15,
     ["password", "forgot password", "reset password", "locked out", "login", "cant login", "can't log in"]),
    ("registration_problems", "ACCOUNT", "medium", 0.15,
     ["registration", "signup error", "cannot register", "can't sign up", "registration failed"]),
    ("place_order", "ORDER", "low", 0.05, ["place order", "buy", "purchase", "order", "add to cart", "checkout"]),
    ("cancel_order", "ORDER", "medium", 0.15,
     ["cancel order", "cancel my order", "cancel purchase", "stop order", "void order", "cancel my subscription",
      "cancel subscription", "cancel"]),
    ("change_order", "ORDER", "medium", 0.15, ["change order", "modify order", "update order", "edit order", "amend order"]),
    ("track_order", "ORDER", "low", 0.05,
     ["track order", "where is my order", "order status", "shipping status", "delivery status"]),
    ("check_payment_methods", "PAYMENT", "low", 0.05,
     ["payment method", "how to pay", "accepted payments", "pay with", "credit card", "debit card"]),
    ("payment_issue", "PAYMENT", "high", 0.35,
     ["payment issue", "payment failed", "payment error", "declined", "charged twice", "double charge", "overcharged",
      "incorrect charge"]),
    ("check_refund_policy", "REFUND", "low", 0.05,
     ["refund policy", "return policy", "can i get a refund", "refund eligibility"]),
    ("get_refund", "REFUND", "medium", 0.20,
     ["refund", "money back", "get refund", "want refund", "request refund", "reimburse"]),
    ("track_refund", "REFUND", "low", 0.05, ["track refund", "refund status", "where is my refund", "refund pending"]),
    ("delivery_options", "SHIPPING", "low", 0.05,
     ["delivery option", "shipping option", "shipping method", "express", "standard delivery"]),
    ("delivery_period", "SHIPPING", "low", 0.05, ["delivery time", "how long", "when will", "estimated delivery", "arrival"]),
    ("change_shipping_address", "SHIPPING", "medium", 0.10,
     ["change address", "shipping address", "wrong address", "update address", "different address"]),
    ("set_up_shipping_address", "SHIPPING", "low", 0.05, ["set up address", "add address", "new address", "setup shipping"]),
    ("shipping_delay", "SHIPPING", "medium", 0.20,
     ["delay", "late", "delayed", "shipping delay", "not arrived", "lost package", "carrier"]),
    ("check_invoice", "INVOICE", "low", 0.05, ["check invoice", "view invoice", "invoice details", "billing statement"]),
    ("get_invoice", "INVOICE", "low", 0.05, ["get invoice", "download invoice", "send invoice", "invoice copy", "receipt"]),
    ("check_cancellation_fee", "CANCELLATION_FEE", "low", 0.10,
     ["cancellation fee", "cancel fee", "penalty", "early termination", "cancellation charge"]),
    ("complaint", "FEEDBACK", "high", 0.40,
     ["complaint", "unhappy", "dissatisfied", "terrible", "worst", "angry", "frustrated", "unacceptable", "horrible",
      "disgusted"]),
    ("review", "FEEDBACK", "low", 0.05, ["review", "feedback", "rate", "experience", "suggestion"]),
    ("newsletter_subscription", "NEWSLETTER", "low", 0.05,
     ["newsletter", "subscribe", "unsubscribe", "mailing list", "email list"]),
    ("contact_customer_service", "CONTACT", "low", 0.10,
     ["contact", "speak to", "talk to", "reach", "call", "customer service", "support line"]),
    ("contact_human_agent", "CONTACT", "medium", 0.45,
     ["human", "real person", "agent", "representative", "escalate", "manager", "supervisor"]),
    ("technical_issue", "TECHNICAL", "medium", 0.20,
     ["error", "bug", "crash", "not working", "broken", "glitch", "failed", "issue", "problem"]),
    ("general_inquiry", "GENERAL", "low", 0.05, ["help", "support", "question", "information", "how to", "what is"]),
]
LEGACY_ROUTE_INTENTS = {
    "refund_duplicate_charge": ["payment_issue", "get_refund", "check_refund_policy"],
    "account_access_recovery": ["recover_password", "registration_problems", "edit_account"],
    "shipping_delay_resolution": ["shipping_delay", "delivery_period", "track_order"],
    "technical_bug_triage": ["technical_issue", "complaint"],
    "general_support_triage": ["general_inquiry", "contact_customer_service"],
}

# -- telemetry buckets ------------------------------------------------------

HISTOGRAM_BUCKETS: dict[str, list[float]] = {
    "http_request_duration_seconds": [0.01, 0.025, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.5, 5.0],
    "issue_text_token_count": [1, 3, 5, 8, 12, 16, 24, 32, 48, 64, 96, 128],
    "decision_confidence": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0],
    "pipeline_stage_duration_seconds": [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0],
    "pipeline_total_duration_seconds": [0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0],
    "request_cost_dollars": [0.0, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05],
    "rag_faithfulness": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
    "rag_hallucination_ratio": [0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0],
    "rag_citation_coverage": [0.0, 0.2, 0.4, 0.6, 0.8, 1.0],
    "retrieval_evidence_score": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
}
