"""Fixed values.

Everything below is part of the data contract: feature order, suffix catalogue,
term lists and numeric settings must keep these exact values for scores and
features to be comparable between runs.
"""

HASH_DIM = 262144
NGRAM_MIN = 3
NGRAM_MAX = 5
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK32 = 4294967295

# Feature names, in vector order.
COUNT_FEATURES = [
    "url_length", "domain_length", "tld_length", "subdomain_count", "letter_count",
    "digit_count", "obfuscated_count", "query_count", "equals_count", "ampersand_count",
    "special_count", "html_line_count", "largest_line_length", "iframe_count", "image_count",
    "css_count", "javascript_count", "self_ref_count", "empty_ref_count", "external_ref_count",
]
RATIO_FEATURES = ["letter_ratio", "digit_ratio", "obfuscated_ratio", "special_ratio"]
BOOLEAN_FEATURES = [
    "is_domain_ip", "is_https", "has_title", "has_favicon", "is_responsive", "has_description",
    "external_form_submit", "has_social", "has_submit_button", "has_hidden_fields",
    "has_password_field", "mentions_bank", "mentions_pay", "mentions_crypto", "has_copyright",
]
NUMERIC_FEATURES = COUNT_FEATURES + RATIO_FEATURES + BOOLEAN_FEATURES
URL_FEATURES = [
    "url_length", "domain_length", "tld_length", "subdomain_count", "letter_count",
    "digit_count", "obfuscated_count", "query_count", "equals_count", "ampersand_count",
    "special_count", "letter_ratio", "digit_ratio", "obfuscated_ratio", "special_ratio",
    "is_domain_ip", "is_https",
]
DOM_FEATURES = [name for name in NUMERIC_FEATURES if name not in URL_FEATURES]

# Suffix catalogue.
SINGLE_SUFFIXES = [
    "ai", "app", "au", "biz", "br", "cn", "co", "com", "dev", "edu", "gov", "info", "int",
    "io", "jp", "kr", "mil", "mx", "net", "nz", "org", "pl", "sa", "sg", "th", "tr", "uk",
    "us", "za",
]
MULTI_SUFFIXES = [
    "ac.th", "ac.uk", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.au",
    "com.br", "com.cn", "com.mx", "com.pl", "com.sa", "com.sg", "com.tr", "edu.au", "go.th",
    "gov.au", "gov.uk", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.nz", "or.jp", "or.th",
    "org.nz", "org.uk",
]

# Reference classification and term lists.
EMPTY_REF_SCHEMES = ["javascript:", "mailto:", "tel:", "data:", "about:"]
SOCIAL_DOMAINS = [
    "facebook.com", "instagram.com", "linkedin.com", "pinterest.com", "reddit.com", "t.co",
    "t.me", "telegram.me", "tiktok.com", "twitter.com", "wa.me", "whatsapp.com", "x.com",
    "youtube.com",
]
BANK_TERMS = ["bank", "banking"]
PAY_TERMS = ["pay", "payment", "paypal", "checkout"]
CRYPTO_TERMS = ["crypto", "bitcoin", "btc", "ethereum", "wallet", "blockchain", "usdt"]
COPYRIGHT_TERMS = ["copyright", "©", "(c)"]
REFERENCE_ATTRIBUTES = {
    "a": "href", "link": "href", "script": "src", "img": "src", "iframe": "src",
    "form": "action",
}

# Labelled CSV: numeric source column -> feature name.
CSV_DOM_COLUMNS = {
    "LineOfCode": "html_line_count",
    "LargestLineLength": "largest_line_length",
    "HasTitle": "has_title",
    "HasFavicon": "has_favicon",
    "IsResponsive": "is_responsive",
    "HasDescription": "has_description",
    "NoOfiFrame": "iframe_count",
    "HasExternalFormSubmit": "external_form_submit",
    "HasSocialNet": "has_social",
    "HasSubmitButton": "has_submit_button",
    "HasHiddenFields": "has_hidden_fields",
    "HasPasswordField": "has_password_field",
    "Bank": "mentions_bank",
    "Pay": "mentions_pay",
    "Crypto": "mentions_crypto",
    "HasCopyrightInfo": "has_copyright",
    "NoOfImage": "image_count",
    "NoOfCSS": "css_count",
    "NoOfJS": "javascript_count",
    "NoOfSelfRef": "self_ref_count",
    "NoOfEmptyRef": "empty_ref_count",
    "NoOfExternalRef": "external_ref_count",
}

# Archives and scorer windows.
MISSING_FAMILY_IDS = ["", "-1", "0", "n/a", "na", "nan", "none", "null", "unknown"]
MAX_METADATA_BYTES = 1048576
MAX_HTML_BYTES = 16777216
WINDOW_SIZE = 128
WINDOW_STRIDE = 64

# Evaluation.
CUTOFF_PERCENTILE = 0.90
BASE_RATE_PREVALENCES = [0.0005, 0.001, 0.005, 0.01, 0.05]
FPR_TARGETS = [0.001, 0.01, 0.05, 0.10, 0.20]
LINEAR_ALPHAS = [1e-5, 1e-4, 1e-3]
TREE_ESTIMATORS = [100, 500]
VARIANTS = ["linear", "tree", "hybrid"]

# Live page records.
MAX_URL_CODE_POINTS = 16384
MAX_TITLE_CODE_POINTS = 4096
MAX_DOM_KEYS = 64
UNSAFE_KEYS = ["__proto__", "constructor", "prototype"]
LATENCY_GATE_MS = 250.0
PAYLOAD_GATE_BYTES = 25 * 1024 * 1024
