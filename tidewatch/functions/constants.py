"""Fixed values.

Everything in this module is a FIXED VALUE that the results depend on: word lists, thresholds,
weights, enum sets and score maps. They are listed plainly, in their natural order. The entity
roster and product labels are neutral names of our own.
"""

# ---------------------------------------------------------------------------------------------
# FIXED VALUES - text similarity
# ---------------------------------------------------------------------------------------------

# Stop words removed before the token cosine (tokens also need length > 2).
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "then", "than", "as", "at", "by",
    "for", "from", "in", "into", "of", "on", "onto", "to", "with", "within",
    "is", "are", "was", "were", "be", "been", "being", "this", "that", "these",
    "those", "it", "its", "their", "they", "which", "while", "over", "under",
    "new", "now", "also",
]

# Headline story matching: ratio >= 0.80 or cosine >= 0.75 (inclusive).
HEADLINE_RATIO_MIN = 0.80
HEADLINE_COSINE_MIN = 0.75
# Change-description matching: ratio > 0.65 or cosine > 0.45 (strict), within 7 days.
DESCRIPTION_RATIO_MIN = 0.65
DESCRIPTION_COSINE_MIN = 0.45
DESCRIPTION_WINDOW_DAYS = 7

# ---------------------------------------------------------------------------------------------
# FIXED VALUES - news sources
# ---------------------------------------------------------------------------------------------

# A source is "high" weight when its lower-cased name contains any of these.
HIGH_VALUE_SOURCES = [
    "techcrunch", "reuters", "bloomberg", "globe and mail", "the globe and mail",
    "financial post", "wall street journal", "the wall street journal",
    "cnbc", "the verge", "axios", "forbes",
]

# Credibility rank = index of the first name contained in the lower-cased source; else the length.
SOURCE_CREDIBILITY_ORDER = [
    "reuters",
    "bloomberg",
    "wall street journal", "the wall street journal",
    "globe and mail", "the globe and mail",
    "financial post",
    "techcrunch",
    "cnbc",
    "the verge",
    "axios",
    "forbes",
    "yahoo finance", "yahoo! finance",
]

# Feed query: per-entity override, else this template; fixed query-string suffix of the feed URL.
NEWS_QUERY_TEMPLATE = "{entity} payments Canada"
FEED_URL_SUFFIX = "&hl=en-CA&gl=CA&ceid=CA:en"

NEWS_CANDIDATES_PER_FEED = 20
NEWS_KEPT_PER_SCAN = 2
NEWS_COVERED_LOOKBACK = 50
NEWS_COVERED_DAYS = 14
MENTIONS_PER_FEED = 10
VIDEOS_PER_FEED = 5
VIDEO_DESCRIPTION_MAX = 200

# ---------------------------------------------------------------------------------------------
# FIXED VALUES - page extraction
# ---------------------------------------------------------------------------------------------

HEADING_TAGS = ["h1", "h2", "h3"]

PRICING_KEYWORDS = [
    "$", "€", "£",
    "/mo", "/month", "/yr", "/year",
    "per month", "per year", "per transaction",
    "%", "fee", "fees", "rate", "rates",
    "pricing", "price", "plan", "plans",
    "subscription", "free trial", "no monthly fee",
    "interchange", "flat rate",
]
PRICING_TAGS = ["div", "span", "p", "td", "li", "h1", "h2", "h3", "h4"]
FEATURE_TEXT_MIN = 3
FEATURE_TEXT_MAX = 200
PRICING_TEXT_MAX = 200
ARTICLE_TITLE_TAGS = ["h1", "h2", "h3", "h4"]
TITLE_CLASS_PATTERN = "(?i)title|headline"
PARAGRAPH_SCAN_LIMIT = 180
PARAGRAPH_MIN_CHARS = 20
PARAGRAPH_KEEP = 60
SNAPSHOT_TEXT_MAX = 200_000
REMOVED_TAGS = ["script", "style", "noscript"]

# ---------------------------------------------------------------------------------------------
# FIXED VALUES - classification contract
# ---------------------------------------------------------------------------------------------

CHANGE_TYPES = ["pricing", "feature", "policy", "UX"]
REVENUE_SENSITIVITY_LEVELS = ["high", "medium", "low"]
SEGMENTS_AFFECTED = ["SMB", "LAKA", "Partners", "Developers"]
THREAT_LEVELS = ["High", "Medium", "Low"]
GAP_LABEL = "GAP"
HOME_PRODUCTS = [
    "Terminals and POS",
    "Online commerce",
    "Developer tools",
    "Tap to pay",
    "Data and insights",
    "Payment facilitation",
    GAP_LABEL,
]
CAMPAIGN_FOCUS_OPTIONS = ["Product launch", "Merchant acquisition", "Brand awareness", "Thought leadership"]
TONE_SHIFT_OPTIONS = ["More aggressive", "Stable", "Retreating"]
OFFER_TYPES = ["free_trial", "hardware_discount", "fee_waiver", "cashback", "bundle", "rate_reduction"]
OFFER_TARGET_SEGMENTS = ["SMB", "LAKA", "New merchants", "Existing merchants"]
OFFER_AGGRESSIVENESS_LEVELS = ["High", "Medium", "Low"]
OFFER_DURATIONS = ["Limited time", "Ongoing"]
OFFER_MATCH_VALUES = ["Yes", "No", "Partial"]
SENTIMENTS = ["negative", "neutral", "positive"]
NEWS_IMPACT_TYPES = ["pricing_change", "product_launch", "policy_change", "funding", "partnership", "other"]
MARKET_IMPACTS = ["high", "medium", "low"]
COMPARISON_RATINGS = ["green", "yellow", "red"]
COMPARISON_DIMENSIONS = [
    "Distribution model",
    "Developer experience",
    "SMB onboarding speed",
    "POS ecosystem strength",
    "Ecommerce strength",
    "Pricing transparency",
    "Canadian market presence",
]
# Missing batch answers are padded with this classification.
NEWS_ANSWER_PAD = {"impact_type": "other", "relevance": 1, "market_impact": "low", "summary": ""}

# ---------------------------------------------------------------------------------------------
# FIXED VALUES - scoring
# ---------------------------------------------------------------------------------------------

SIGNAL_WEIGHTS = {
    "review": 0.20,
    "news": 0.20,
    "velocity": 0.15,
    "static": 0.20,
    "social": 0.15,
    "offers": 0.10,
}
VELOCITY_BASELINE = 2.0
NEWS_BASELINE = 3.0
SOCIAL_BASELINE = 5.0
OFFERS_BASELINE = 3.0
REVIEW_BASELINE = 5.0
STATIC_DEFAULT = 5
TONE_SCORES = {"More aggressive": 9.0, "Stable": 5.0, "Retreating": 2.0}
FOCUS_SCORES = {
    "Merchant acquisition": 8.0,
    "Product launch": 7.0,
    "Thought leadership": 4.0,
    "Brand awareness": 3.0,
}
UNKNOWN_LABEL_SCORE = 5.0
AGGRESSIVENESS_SCORES = {"High": 9.0, "Medium": 5.5, "Low": 2.5}
OFFERS_IN_SCORE = 10
IMPACT_GATE_MIN = 2
TREND_EPSILON = 0.05
BAND_HIGH = 7
BAND_MID = 4

# ---------------------------------------------------------------------------------------------
# FIXED VALUES - read views
# ---------------------------------------------------------------------------------------------

CHANGES_VIEW_LIMIT = 500
CHANGES_VIEW_DAYS = 90
NEWS_VIEW_LIMIT = 500
NEWS_VIEW_DAYS = 90
PRODUCT_VIEW_LIMIT = 1000
OFFERS_VIEW_LIMIT = 1000
SCORE_CUTOFF = "2025-01-01T00:00:00+00:00"
UNAVAILABLE_MARKER = "explanation unavailable"
REASON_FALLBACK = "Threat score updated; explanation unavailable due to an analysis error."

# ASCII folding for exports: these 17 replacements, then anything outside Latin-1 becomes '?'.
ASCII_FOLD = [
    ("—", "--"),
    ("–", "-"),
    ("‘", "'"),
    ("’", "'"),
    ("“", '"'),
    ("”", '"'),
    ("…", "..."),
    ("·", "*"),
    ("©", "(c)"),
    ("®", "(R)"),
    ("™", "(TM)"),
    ("°", "deg"),
    ("→", "->"),
    ("←", "<-"),
    ("•", "-"),
    ("½", "1/2"),
    ("¼", "1/4"),
]

# Weekly brief text cuts (characters).
BRIEF_REASON_CHARS = 90
BRIEF_CHANGE_CHARS = 220
BRIEF_COMPLAINT_CHARS = 130
BRIEF_NEWS_CHARS = 110
BRIEF_MATRIX_CHARS = 160

# ---------------------------------------------------------------------------------------------
# FIXED VALUES - zone names of mail headers (RFC 2822, section 4.3)
# ---------------------------------------------------------------------------------------------

MAIL_ZONES = {
    "AST": "-0400",
    "ADT": "-0300",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}
