"""Word lists and tables that results depend on."""

GENERIC_ANCHORS = (
    "click here", "here", "read more", "more", "learn more", "link",
    "this", "this page", "find out more", "see more", "view more",
)

CTA_PHRASES = (
    "get started", "sign up", "signup", "register", "buy now", "buy",
    "shop", "order", "book", "book a demo", "book a consultation",
    "book a call", "demo", "request a demo", "get a quote", "get quote",
    "quote", "contact us", "contact", "call us", "call now", "phone",
    "download", "subscribe", "join", "try", "start free", "free trial",
    "add to cart", "add to basket", "checkout", "enquire", "enquiry",
    "apply", "claim", "get my", "schedule", "reserve", "submit", "send",
)

GENERIC_CTAS = ("submit", "click here", "go", "send", "ok", "more", "learn more")

TRUST_KEYWORDS = (
    "guarantee", "money-back", "money back", "refund", "warranty",
    "testimonial", "testimonials", "reviews", "reviewed", "rated",
    "stars", "trusted by", "as seen", "certified", "accredited",
    "award", "secure checkout", "ssl secure", "verified", "trustpilot",
    "feefo", "google reviews", "years of experience", "years in business",
)

URGENCY_KEYWORDS = (
    "limited time", "limited offer", "ends soon", "offer ends", "% off",
    "sale ends", "last chance", "countdown", "today only", "expires",
    "only a few left", "selling fast",
)

LIVE_CHAT_MARKERS = (
    "intercom", "drift", "zendesk", "tidio", "livechat", "crisp",
    "live-chat", "live_chat", "chat-widget", "olark",
)

CAPTCHA_MARKERS = ("recaptcha", "hcaptcha", "turnstile")

DATE_NAMES = ("article:published_time", "article:modified_time", "date", "dc.date")

FRAMEWORK_MARKERS = (
    "__NEXT_DATA__", "_next/", "data-reactroot", "data-react-helmet",
    "ng-app", "ng-version", "data-v-", "__NUXT__", "_nuxt/", "__VUE__",
    "data-astro", "webpackJsonp", "gatsby", "sveltekit", "__sveltekit",
)

SHELL_MARKERS = ('<div id="root"', '<div id="app"', '<div id="__next"', '<div id="__nuxt"', '<div id="svelte"')

QUESTION_STARTERS = ("how", "what", "why", "when", "which", "who", "where", "can", "does", "do", "is", "are", "should")

KEYWORD_STOPS = ("the", "a", "an", "and", "or", "for", "with", "to", "of", "in", "on", "your", "our", "best", "guide", "2025", "2026")

#: Ordered: the first signature found in the lower-cased agent names the bot.
BOTS = (
    ("Googlebot", "googlebot"),
    ("Bingbot", "bingbot"),
    ("GPTBot", "gptbot"),
    ("OAI-SearchBot", "oai-searchbot"),
    ("ClaudeBot", "claudebot"),
    ("PerplexityBot", "perplexitybot"),
    ("Google-Extended", "google-extended"),
    ("CCBot", "ccbot"),
    ("AhrefsBot", "ahrefsbot"),
    ("SemrushBot", "semrushbot"),
    ("Bytespider", "bytespider"),
)

LOG_LINE = r'^\S+ \S+ \S+ \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+) "([^"]*)" "([^"]*)"'

REDIRECTS = (301, 302, 303, 307, 308)

#: Seconds that a response of a command stays fresh.
TTL = {
    "serp": 21600, "volume": 604800, "ideas": 604800, "related": 604800, "ranked": 86400,
    "competitors": 86400, "intersection": 86400, "backlinks": 604800, "refdomains": 604800,
    "anchors": 604800, "onpage": 86400, "lighthouse": 86400, "content": 86400, "mentions": 86400,
    "business": 604800, "whois": 2592000, "amazon": 86400, "trends": 604800, "serp-maps": 21600,
    "serp-news": 21600, "serp-bing": 21600, "serp-youtube": 21600, "autocomplete": 86400,
    "kd": 604800, "backlinks-history": 86400, "bulk-ranks": 86400, "technologies": 2592000,
}
DEFAULT_TTL = 86400

SEVERITY_WEIGHT = {"critical": 25, "high": 15, "medium": 8, "low": 3}
SEVERITIES = ("critical", "high", "medium", "low")
STATUSES = ("open", "accepted", "done", "ignored", "resolved")
CLOSED = ("done", "ignored", "resolved")
PILLARS = {"technical": 0.30, "content": 0.25, "authority": 0.20, "cwv": 0.15, "ai_search": 0.10}
CTR = (0.25, 0.13, 0.08, 0.055, 0.04, 0.03, 0.023, 0.018, 0.014, 0.01)
CTR_SECOND_PAGE, CTR_BEYOND, BAND = 0.004, 0.001, (0.6, 1.4)
