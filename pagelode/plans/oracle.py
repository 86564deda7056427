"""DuckDB twins of the catalogue queries."""

STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({h}, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""
UNESC = "replace(replace(replace(replace(replace(replace(replace(replace({t}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&#39;', ''''), '&amp;', '&')"


def unesc(t):
    return UNESC.format(t=t)


def squeeze(t):
    return rf"trim(regexp_replace({t}, '[\s ]+', ' ', 'g'))"


NOTAGS = "regexp_replace({t}, '<[^>]*>', ' ', 'g')"
LINK = r"""(?is)<a\b[^>]*?\shref="([^"]*)"[^>]*>(.*?)</a\s*>"""
NETLOC = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"

PAGES = f"""
c AS (SELECT page_id, url, html, {STRIP.format(h="html")} AS clean FROM pages),
v AS (SELECT *, {unesc(NOTAGS.format(t="clean"))} AS visible, {NETLOC.format(u="url")} AS host,
        regexp_extract_all(clean, '{LINK}', 1) AS hrefs FROM c),
r AS (
  SELECT page_id, url, host,
    {squeeze(unesc("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title,
    trim(regexp_extract(html, '(?is)<html\\b[^>]*\\slang="([^"]*)"', 1)) AS html_lang,
    len(regexp_extract_all(visible, '[\\p{{L}}\\p{{N}}_]+')) AS word_count,
    list_filter(list_transform(regexp_extract_all(clean, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), lambda x: {squeeze(unesc(NOTAGS.format(t="x")))}), lambda x: x <> '') AS h1,
    len(hrefs) AS links,
    len(list_filter(hrefs, lambda x: NOT regexp_matches(lower({unesc("x")}), '^https?://') OR (host <> '' AND {NETLOC.format(u=unesc("x"))} = host))) AS internal_link_count,
    len(regexp_extract_all(clean, '(?i)<ul[\\s>/]')) + len(regexp_extract_all(clean, '(?i)<ol[\\s>/]')) AS list_count,
    len(regexp_extract_all(clean, '(?i)<img[\\s>/]')) AS images_total,
    len(regexp_extract_all(clean, '(?i)<meta\\s[^>]*name="viewport"')) > 0 AS has_viewport,
    len(regexp_extract_all(clean, '(?i)<nav[\\s>/]')) > 0 AS has_nav,
    len(regexp_extract_all(clean, '(?i)<main[\\s>/]')) > 0 AS has_main,
    len(regexp_extract_all(clean, '(?i)<h2[\\s>/]')) AS h2_count,
    regexp_extract(clean, '(?is)<link\\b[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS canonical,
    regexp_extract(clean, '(?is)<meta\\b[^>]*name="description"[^>]*content="([^"]*)"', 1) AS meta_description,
    len(regexp_extract_all(html, '(?i)application/ld\\+json')) AS schema_blocks
  FROM v
)"""

LACKS = "NOT coalesce(list_contains(list_transform(schema_types, lambda x: lower(x)), '{0}'), false)"
ZERO = "coalesce({0}, 0) = 0"
BLANK = "coalesce({0}, '') = ''"
#: id, category, severity and when it fires, as the rules are documented; in load order.
RULES = (
    *((i, "accessibility", s, f"coalesce({c}, 0) >= 1") for i, s, c in (("duplicate-id", "high", "duplicate_ids"), ("empty-button", "high", "empty_buttons"), ("empty-link", "high", "empty_links"), ("form-input-unlabelled", "high", "form_inputs_unlabelled"), ("generic-link-text", "low", "generic_link_texts"), ("heading-order-skip", "medium", "heading_skips"), ("iframe-missing-title", "medium", "iframes_missing_title"))),
    *((i, "accessibility", s, f"NOT coalesce({c}, false)") for i, s, c in (("missing-main-landmark", "medium", "has_main"), ("missing-nav-landmark", "low", "has_nav"), ("missing-skip-link", "medium", "has_skip_link"))),
    ("positive-tabindex", "accessibility", "medium", "coalesce(positive_tabindex, 0) >= 1"),
    ("table-missing-headers", "accessibility", "medium", "coalesce(tables_without_th, 0) >= 1"),
    ("thin-content", "content", "high", "coalesce(word_count, 0) < 300"),
    ("very-thin-content", "content", "critical", "coalesce(word_count, 0) < 100"),
    ("competing-ctas", "cro", "medium", "coalesce(cta_count, 0) >= 7"),
    ("form-has-captcha", "cro", "low", "coalesce(form_has_captcha, false)"),
    ("generic-primary-cta", "cro", "medium", "coalesce(primary_cta_generic, false)"),
    ("high-form-friction", "cro", "high", "coalesce(form_fields_max, 0) >= 6"),
    ("missing-contact-option", "cro", "low", ZERO.format("tel_links")),
    ("missing-faq", "cro", "low", "NOT coalesce(faq_present, false)"),
    ("missing-trust-signals", "cro", "high", ZERO.format("trust_signal_count")),
    ("no-cta-above-fold", "cro", "high", ZERO.format("cta_above_fold")),
    ("no-cta", "cro", "critical", ZERO.format("cta_count")),
    ("no-urgency-signal", "cro", "low", ZERO.format("urgency_signal_count")),
    ("missing-h1", "headings", "critical", ZERO.format("h1_count")),
    ("missing-h2", "headings", "medium", ZERO.format("h2_count")),
    ("multiple-h1", "headings", "high", "coalesce(h1_count, 0) > 1"),
    ("images-missing-alt", "images", "high", "coalesce(images_missing_alt, 0) >= 1"),
    ("canonical-relative", "indexability", "medium", "starts_with(canonical, '/')"),
    ("fetch-status-error", "indexability", "critical", "status <> 200"),
    ("js-content-gap", "indexability", "high", "coalesce(js_content_ratio, 0) >= 1.5"),
    ("missing-canonical", "indexability", "medium", "canonical = ''"),
    ("page-noindex", "indexability", "high", "coalesce(noindex, false)"),
    ("page-not-https", "indexability", "medium", "NOT contains(lower(url), 'https://')"),
    ("missing-html-lang", "international", "medium", BLANK.format("html_lang")),
    ("few-internal-links", "links", "low", "coalesce(internal_link_count, 0) < 3"),
    ("no-external-links", "links", "low", ZERO.format("external_link_count")),
    ("meta-description-too-long", "metadata", "low", "coalesce(meta_description_length, 0) > 170"),
    ("meta-description-too-short", "metadata", "low", "coalesce(meta_description_length, 0) < 70"),
    ("missing-meta-description", "metadata", "high", BLANK.format("meta_description")),
    ("missing-title", "metadata", "critical", BLANK.format("title")),
    ("title-too-long", "metadata", "medium", "coalesce(title_length, 0) > 65"),
    ("title-too-short", "metadata", "low", "coalesce(title_length, 0) < 30"),
    ("missing-viewport", "mobile", "high", "NOT coalesce(has_viewport, false)"),
    ("missing-article-schema", "schema", "low", LACKS.format("article")),
    ("missing-breadcrumb-schema", "schema", "low", LACKS.format("breadcrumblist")),
    ("missing-jsonld", "schema", "high", ZERO.format("schema_blocks")),
    ("missing-organization-schema", "schema", "low", LACKS.format("organization")),
    ("missing-csp", "security", "low", "NOT coalesce(security_csp, false)"),
    ("missing-hsts", "security", "low", "NOT coalesce(security_hsts, false)"),
    ("mixed-content", "security", "high", "coalesce(mixed_content_count, 0) >= 1"),
    ("missing-og-title", "social", "low", BLANK.format("og_title")),
    ("missing-twitter-card", "social", "low", BLANK.format("twitter_card")),
)
WEIGHT = {"critical": 25, "high": 15, "medium": 8, "low": 3}

LEGACY = r"regexp_replace({t}, '&(copy|middot|quot|lt|gt|nbsp|laquo|raquo|amp)([^;a-z]|$)', '&\1;\2', 'g')"
TRUST = ("guarantee", "money-back", "money back", "refund", "warranty", "testimonial", "testimonials", "reviews", "reviewed", "rated", "stars", "trusted by", "as seen", "certified", "accredited", "award", "secure checkout", "ssl secure", "verified", "trustpilot", "feefo", "google reviews", "years of experience", "years in business")
URGENT = ("limited time", "limited offer", "ends soon", "offer ends", "% off", "sale ends", "last chance", "countdown", "today only", "expires", "only a few left", "selling fast")
CALLS = ("get started", "sign up", "signup", "register", "buy now", "buy", "shop", "order", "book", "book a demo", "book a consultation", "book a call", "demo", "request a demo", "get a quote", "get quote", "quote", "contact us", "contact", "call us", "call now", "phone", "download", "subscribe", "join", "try", "start free", "free trial", "add to cart", "add to basket", "checkout", "enquire", "enquiry", "apply", "claim", "get my", "schedule", "reserve", "submit", "send")


def listed(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def tags(name, more="", where="true"):
    """Opening tags of a name, as a list, for which ``where`` holds of x."""
    return rf"list_filter(regexp_extract_all(clean, '(?is)<{name}\b[^>]*>'), lambda x: {where})"


def having(name, attribute, value=None):
    test = f"regexp_matches(x, '(?is)\\s{attribute}\\s*=\\s*\"" + ("[^\"]*[^\"\\s][^\"]*\"')" if value is None else f"{value}\"')")
    return tags(name, where=test), tags(name, where=f"NOT {test}")


def occurrences(words):
    return f"list_sum(list_transform({listed(words)}, lambda w: (length(low) - length(replace(low, w, ''))) // length(w)))::BIGINT"


# the rules' fields of every page, by patterns over the whole page and, for calls to action, over its tags in order
RECORD = rf"""
, cv AS (SELECT page_id, url, html, host, clean, hrefs, {unesc(LEGACY.format(t="regexp_replace(clean, '(<[^>]*>)+', ' ', 'g')"))} AS visible FROM v),
tk AS (SELECT page_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<script\b[^>]*>).*?</script>', '\1', 'g'), '<[^>]*>|[^<]+') AS toks FROM pages)),
el AS (SELECT *, sum(CASE WHEN regexp_matches(tok, '^<[a-zA-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS seen,
  max(CASE WHEN regexp_matches(tok, '(?is)^<a\b[^>]*\shref="[^"]+"|^<button\b') THEN pos END) OVER (PARTITION BY page_id ORDER BY pos) AS opened FROM tk),
bd AS (SELECT page_id, coalesce(max(seen) FILTER (regexp_matches(tok, '(?i)^<body\b')), 0) AS body, max(seen) AS total FROM el GROUP BY ALL),
ca AS (SELECT c.page_id, c.pos, c.seen, {squeeze(unesc("coalesce(string_agg(t.tok, ' ' ORDER BY t.pos) FILTER (NOT starts_with(t.tok, '<')), '')"))} AS said
  FROM el c JOIN el t ON t.page_id = c.page_id AND t.pos BETWEEN c.opened AND c.pos WHERE regexp_matches(c.tok, '(?i)^</(a|button)\s*>') GROUP BY ALL),
cc AS (SELECT page_id, count(*) AS cta_count, count(*) FILTER (seen < body + 0.4::DOUBLE * greatest(total - body, 1)) AS cta_above_fold, lower(arg_min(said, pos)) IN ('submit', 'click here', 'go', 'send', 'ok', 'more', 'learn more') AS primary_cta_generic
  FROM ca JOIN bd USING (page_id) WHERE len(list_filter({listed(CALLS)}, lambda w: contains(lower(said), w))) > 0 GROUP BY ALL),
q AS (SELECT *, lower(visible) AS low,
    list_filter(list_transform(regexp_extract_all(clean, '(?is)<[a-z][^>]*?\sid="([^"]*)"', 1), lambda x: x), lambda x: x <> '') AS ids,
    list_transform(regexp_extract_all(clean, '(?is)<a\b[^>]*?\shref="[^"]+"[^>]*>(.*?)</a\s*>', 1), lambda x: {squeeze(unesc(NOTAGS.format(t="x")))}) AS anchors,
    list_transform(regexp_extract_all(clean, '(?i)<h([1-6])\b', 1), lambda x: x::INT) AS levels,
    regexp_extract_all(html, '(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script', 1) AS blocks,
    regexp_replace(clean, '(?is)<label\b.*?</label\s*>', ' ', 'g') AS unlabelled FROM cv),
lr AS (
  SELECT q.page_id, q.url, 200 AS status, NULL::DOUBLE AS js_content_ratio, NULL::BOOLEAN AS security_csp, NULL::BOOLEAN AS security_hsts,
    r.title, length(r.title) AS title_length, r.html_lang, len(r.h1) AS h1_count, r.h2_count, r.internal_link_count, r.links - r.internal_link_count AS external_link_count, r.canonical, r.has_viewport,
    trim(r.meta_description) AS meta_description, length(trim(r.meta_description)) AS meta_description_length,
    len(regexp_extract_all(visible, '[\p{{L}}\p{{N}}_]+')) AS word_count, len(ids) - len(list_distinct(ids)) AS duplicate_ids,
    len(list_filter(regexp_extract_all(clean, '(?is)<button\b[^>]*>.*?</button\s*>'), lambda x: trim({NOTAGS.format(t="x")}) = '' AND NOT contains(x, 'aria-label'))) AS empty_buttons,
    len(list_filter(regexp_extract_all(clean, '(?is)<a\b[^>]*?\shref="[^"]+"[^>]*>.*?</a\s*>'), lambda x: trim({NOTAGS.format(t="x")}) = '' AND NOT regexp_matches(x, '(?is)aria-label="[^"]|alt="[^"]*[^"\s]'))) AS empty_links,
    len(list_filter(regexp_extract_all(unlabelled, '(?is)<(?:input|textarea|select)\b[^>]*>'), lambda x: NOT regexp_matches(x, '(?i)type="(hidden|submit|button|reset)"|aria-label|title=') AND NOT contains(clean, 'for="' || regexp_extract(x, '(?i)id="([^"]+)"', 1) || '"'))) AS form_inputs_unlabelled,
    len(list_filter(anchors, lambda x: lower(x) IN ('click here', 'here', 'read more', 'more', 'learn more', 'link', 'this', 'this page', 'find out more', 'see more', 'view more'))) AS generic_link_texts,
    len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] > levels[i - 1] + 1)) AS heading_skips,
    len({having("iframe", "title")[1]}) AS iframes_missing_title, r.has_main OR len({having("[a-z]+", "role", "main")[0]}) > 0 AS has_main, r.has_nav OR len({having("[a-z]+", "role", "navigation")[0]}) > 0 AS has_nav,
    regexp_matches(clean, '(?is)<a\b[^>]*\shref="#[^>]*>[^<]*skip') AS has_skip_link, len({having("[a-z]+", "tabindex", "0*[1-9][0-9]*")[0]}) AS positive_tabindex,
    len(list_filter(regexp_extract_all(clean, '(?is)<table\b.*?</table\s*>'), lambda x: NOT regexp_matches(x, '(?i)<th\b'))) AS tables_without_th,
    coalesce(cta_count, 0) AS cta_count, coalesce(cta_above_fold, 0) AS cta_above_fold, coalesce(primary_cta_generic, false) AS primary_cta_generic,
    regexp_matches(html, '(?is)<(script|style|noscript)\b[^>]*src="[^"]*(recaptcha|hcaptcha|turnstile)') AS form_has_captcha,
    coalesce(list_max(list_transform(regexp_extract_all(clean, '(?is)<form\b.*?</form\s*>'), lambda x: len(regexp_extract_all(x, '(?i)<(input|textarea|select)\b')))), 0) AS form_fields_max,
    len(list_filter(hrefs, lambda x: starts_with(lower(x), 'tel:'))) AS tel_links, {occurrences(TRUST)} AS trust_signal_count, {occurrences(URGENT)} AS urgency_signal_count,
    contains(lower(array_to_string(blocks, ' ')), '"faqpage"') OR regexp_matches(clean, '(?is)<h2\b[^>]*>[^<]*(faq|frequently asked)') AS faq_present,
    len({having("img", "alt")[1]}) AS images_missing_alt, regexp_matches(clean, '(?is)<meta\b[^>]*name="robots"[^>]*noindex') AS noindex, len(blocks) AS schema_blocks,
    flatten(list_transform(blocks, lambda b: regexp_extract_all(b, '"@type"\s*:\s*"([^"]*)"', 1))) AS schema_types,
    len(regexp_extract_all(html, '(?is)<(?:(?:script|style|noscript|img)\b[^>]*?\ssrc|link\b[^>]*?\shref)="http://')) AS mixed_content_count,
    regexp_extract(clean, '(?is)<meta\b[^>]*(?:name|property)="og:title"[^>]*content="([^"]*)"', 1) AS og_title, regexp_extract(clean, '(?is)<meta\b[^>]*(?:name|property)="twitter:card"[^>]*content="([^"]*)"', 1) AS twitter_card
  FROM q JOIN r USING (page_id) LEFT JOIN cc USING (page_id)
)"""

FOUND = (
    "WITH "
    + PAGES
    + RECORD
    + ", f AS ("
    + " UNION ALL ".join(f"SELECT page_id, '{i}' AS rule_id, '{c}' AS category, '{s}' AS severity, {WEIGHT[s]} AS weight FROM lr WHERE {q}" for i, c, s, q in RULES)
    + "), s AS (SELECT lr.page_id, lr.url, greatest(0, 100 - coalesce(sum(weight), 0)) AS score, count(rule_id) AS failed FROM lr LEFT JOIN f USING (page_id) GROUP BY ALL)"
)

EDGES = """
n AS (SELECT max(page_id) + 2 AS n FROM pages WHERE page_id % 5 <> 4),
e AS (
  SELECT page_id AS src, t - CASE WHEN t % 11 = 3 THEN 1 ELSE 0 END AS dst, k AS pos,
         ['click here', 'Read more', 'Guide', 'Pricing', 'here'][(page_id + k) % 5 + 1] AS anchor
  FROM (SELECT page_id, k, (page_id * 7 + k * k * 3) % (SELECT n FROM n) AS t FROM pages, (SELECT unnest([1, 2, 3]) AS k) WHERE page_id % 5 <> 4)
), kn AS (SELECT e.* FROM e WHERE dst IN (SELECT page_id FROM pages))"""
BFS = """, w(node, depth) AS (
  SELECT page_id, 0 FROM pages WHERE page_id = 0
  UNION SELECT kn.dst, w.depth + 1 FROM w JOIN kn ON kn.src = w.node WHERE w.depth < 30
), d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)"""

LOGS = """
l AS (
  SELECT strftime(ts, '%d/%b/%Y') AS day, ts, event_type <> 'error' AS parsed,
    '/' || event_type || '/' || (event_id % 13) || CASE WHEN event_id % 3 = 0 THEN '?ref=x' ELSE '' END AS path,
    CASE WHEN event_id % 10 = 0 THEN '404' ELSE '200' END AS status, event_id % 3 = 0 AS has_params,
    ['Googlebot', 'Bingbot', 'GPTBot', 'ClaudeBot', NULL][user_id % 5 + 1] AS bot
  FROM events
), b AS (SELECT * FROM l WHERE parsed AND bot IS NOT NULL)"""

RANK = """
{name} AS (
  SELECT 'part ' || l_partkey AS keyword, row_number() OVER (ORDER BY q DESC, l_partkey) AS position, CAST(q AS BIGINT) AS volume
  FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE year(l_shipdate) = {year} GROUP BY 1)
)"""
RANKS = RANK.format(name="old", year=1998) + "," + RANK.format(name="new", year=1999)
SUP = """
{name} AS (
  SELECT l_suppkey AS supplier, 'part ' || l_partkey AS keyword, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS position, CAST(q AS BIGINT) AS volume
  FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem WHERE year(l_shipdate) = {year} GROUP BY 1, 2)
)"""
SUPS = SUP.format(name="old", year=1998) + "," + SUP.format(name="new", year=1999)
CTR = "(CASE WHEN {p} <= 10 THEN [0.25, 0.13, 0.08, 0.055, 0.04, 0.03, 0.023, 0.018, 0.014, 0.01][greatest({p}, 1)] WHEN {p} <= 20 THEN 0.004 ELSE 0.001 END)::DOUBLE"
RECS = """
x AS (
  SELECT user_id AS id, event_id AS seq, epoch(date_trunc('second', ts))::BIGINT AS ts, event_type IN ('error', 'view', 'signup') AS raised,
    ['open', 'accepted', 'done', 'ignored', 'resolved', 'bogus'][event_id % 6 + 1] AS status,
    ['critical', 'high', 'medium', 'low'][event_id % 4 + 1] AS severity FROM events
), g AS (SELECT *, sum(raised::INT) OVER (PARTITION BY id ORDER BY seq) AS born FROM x),
k AS (SELECT * FROM g WHERE born > 0 AND (raised OR status <> 'bogus')),
-- the last status event decides, unless a raise after it reopens a done or resolved one
ls AS (SELECT id, max(seq) FILTER (WHERE NOT raised) AS s_seq, max(seq) FILTER (WHERE raised) AS r_seq, count(*) FILTER (WHERE raised) AS times_raised,
        min(ts) AS created, arg_max(ts, seq) AS updated, arg_max(severity, seq) FILTER (WHERE raised) AS severity FROM k GROUP BY id),
st AS (
  SELECT ls.id, times_raised, created, updated, ls.severity,
    CASE WHEN s_seq IS NULL THEN 'open' WHEN r_seq > s_seq AND k.status IN ('done', 'resolved') THEN 'open' ELSE k.status END AS status
  FROM ls LEFT JOIN k ON k.id = ls.id AND k.seq = ls.s_seq
)"""
LEDGER = "l AS (SELECT epoch(date_trunc('second', ts))::BIGINT AS ts, event_type AS command, CAST(round(value * 100) AS BIGINT) AS cost, event_id FROM events), nw AS (SELECT max(ts) AS now FROM l)"
HOPS = """
h AS (
  SELECT 'u' || page_id AS url,
    CASE WHEN page_id % 6 = 0 THEN 301 WHEN page_id % 6 = 1 THEN 302 WHEN page_id % 11 = 5 THEN 404 ELSE 200 END AS status,
    CASE WHEN page_id % 12 = 6 THEN '' WHEN page_id % 6 = 0 THEN 'u' || (page_id + 1) WHEN page_id % 30 = 1 THEN 'u' || (page_id - 1) WHEN page_id % 6 = 1 THEN 'u' || (page_id + 1) ELSE '' END AS location
  FROM pages
), t(start, url, path, redirects, n) AS (
  SELECT url, url, [url], 0, 0 FROM h
  UNION ALL
  SELECT t.start, h.location, list_append(path, h.location), redirects + 1, n + 1 FROM t JOIN h ON h.url = t.url
  WHERE h.status IN (301, 302, 303, 307, 308) AND h.location <> '' AND NOT list_contains(path, h.location) AND n < 10
), la AS (SELECT start, arg_max(url, n) AS url, max(redirects) AS redirects, arg_max(path, n) AS path FROM t GROUP BY start),
fi AS (SELECT la.*, coalesce(h.status, 0) AS status, coalesce(h.location, '') AS location, coalesce(h.status, 0) IN (301, 302, 303, 307, 308) AS re FROM la LEFT JOIN h ON h.url = la.url),
tr AS (
  SELECT start, url AS final_url, status AS final_status, redirects + re::INT AS redirect_count,
    CASE WHEN re AND location = '' THEN 'broken_location' WHEN re THEN 'loop_or_limit' WHEN status = 0 THEN 'request_failed' WHEN status <> 200 THEN 'non_200_final'
         WHEN redirects + re::INT > 1 THEN 'redirect_chain' ELSE 'ok' END AS verdict FROM fi
)"""


def half_up(x, scale=10):
    return f"floor(({x}) * {scale}.0 + 0.5) / {scale}"


SQL = {
    "page_extract": f"WITH {PAGES} SELECT page_id, url, title, length(title) AS title_length, html_lang, array_to_string(h1, '|') AS h1_text, len(h1) AS h1_count, word_count, internal_link_count, links - internal_link_count AS external_link_count, list_count, images_total, has_viewport, has_nav FROM r",
    "page_links": f"""WITH {PAGES}, p AS (SELECT page_id, url, host, unnest(hrefs) AS h, unnest(regexp_extract_all(clean, '{LINK}', 2)) AS a, generate_subscripts(hrefs, 1) - 1 AS pos FROM v)
        SELECT page_id, pos, {unesc("h")} AS href, left({squeeze(unesc(NOTAGS.format(t="a")))}, 120) AS anchor,
          CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || regexp_replace({unesc("h")}, '#.*$', '') END AS target, true AS internal FROM p""",
    "url_normalise": f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {NETLOC.format(u='url')} || CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '([?][^#]*)', 1) AS normal_url, {NETLOC.format(u='url')} AS host FROM pages",
    "lint_findings": FOUND + " SELECT page_id, rule_id, category, severity, weight FROM f",
    "lint_scores": FOUND + " SELECT page_id, url, score, failed FROM s",
    "lint_gate": FOUND + " SELECT page_id, score FROM s WHERE score < 30",
    "lint_rollup": FOUND + " SELECT coalesce(category, 'all') AS category, coalesce(severity, 'all') AS severity, count(*) AS n, sum(weight) AS lost FROM f GROUP BY ROLLUP (f.category, f.severity)",
    "crawl_summary": f"WITH {PAGES}, q AS (SELECT *, CASE WHEN page_id % 17 = 3 THEN 404 ELSE 200 END AS status FROM r) SELECT count(*) AS pages, count(*) FILTER (status = 200) AS ok_pages, count(*) FILTER (status <> 200) AS failed_pages, count(*) FILTER (status = 200 AND title = '') AS missing_titles, count(*) FILTER (status = 200 AND len(h1) = 0) AS missing_h1, count(*) FILTER (status = 200 AND len(h1) > 1) AS multiple_h1, count(*) FILTER (status = 200 AND meta_description = '') AS missing_descriptions, count(*) FILTER (status = 200 AND word_count < 300) AS thin_pages, sum(CASE WHEN status = 200 THEN word_count ELSE 0 END) AS words, sum(CASE WHEN status = 200 THEN internal_link_count ELSE 0 END) AS internal_links FROM q",
    "duplicate_titles": f"WITH {PAGES} SELECT title, count(*) AS n, min(page_id) AS first_page FROM r WHERE title <> '' GROUP BY title HAVING count(*) > 1",
    "status_distribution": "SELECT coalesce(CAST(CASE WHEN page_id % 17 = 3 THEN 404 WHEN page_id % 23 = 1 THEN NULL ELSE 200 END AS VARCHAR), 'None') AS status, count(*) AS n FROM pages GROUP BY 1",
    "sitemap_diff": "WITH s AS (SELECT DISTINCT rtrim(url, '/') AS url FROM pages WHERE page_id % 3 <> 0), c AS (SELECT DISTINCT rtrim(url, '/') AS url FROM pages WHERE page_id % 4 <> 0) SELECT url, 'left' AS side FROM (SELECT url FROM s EXCEPT SELECT url FROM c) UNION ALL SELECT url, 'right' FROM (SELECT url FROM c EXCEPT SELECT url FROM s)",
    "near_dup_pairs": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w)),
        n AS (SELECT doc_id, count(*) AS n, list_sort(list(g)) AS k FROM s GROUP BY 1), h AS (SELECT doc_id, n, k, min(doc_id) OVER (PARTITION BY k) AS head FROM n),
        q AS (SELECT s.doc_id, s.g, h.n FROM s JOIN h USING (doc_id) WHERE h.doc_id = h.head),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM q a JOIN q b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
        SELECT a, b, c / (na + nb - c) AS similarity FROM p WHERE c / (na + nb - c) >= 0.9""",
    "near_dup_classes": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS k FROM w)
        SELECT head, count(*) AS n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS head FROM s) GROUP BY head HAVING count(*) > 1""",
    "link_degree": f"WITH {EDGES} SELECT page_id AS node, (SELECT count(*) FROM kn WHERE dst = page_id) AS inlinks, (SELECT count(*) FROM e WHERE src = page_id) AS outlinks FROM pages",
    "orphans": f"WITH {EDGES} SELECT page_id AS node FROM pages WHERE page_id <> 0 AND page_id NOT IN (SELECT dst FROM e)",
    "hubs_topk": f"WITH {EDGES} SELECT dst AS node, count(*) AS inlinks FROM kn GROUP BY 1 ORDER BY inlinks DESC, node DESC LIMIT 15",
    "bfs_depth": f"WITH RECURSIVE {EDGES}{BFS} SELECT node, depth FROM d",
    "depth_distribution": f"WITH RECURSIVE {EDGES}{BFS} SELECT depth, count(*) AS n FROM d GROUP BY depth",
    "bfs_parents": f"WITH RECURSIVE {EDGES}{BFS} SELECT d.node, d.depth, (SELECT min(kn.src) FROM kn JOIN d u ON u.node = kn.src AND u.depth = d.depth - 1 WHERE kn.dst = d.node) AS parent FROM d",
    "unreachable": f"WITH RECURSIVE {EDGES}{BFS} SELECT page_id AS node FROM pages WHERE page_id NOT IN (SELECT node FROM d)",
    "anchor_quality": f"WITH {EDGES} SELECT count(*) AS anchors, count(*) FILTER (lower(anchor) IN ('click here', 'here', 'read more')) AS generic, {half_up('count(*) FILTER (lower(anchor) IN (\'click here\', \'here\', \'read more\')) * 100.0 / count(*)')} AS generic_pct FROM e",
    "top_anchors": f"WITH {EDGES} SELECT anchor, count(*) AS n FROM e GROUP BY anchor ORDER BY n DESC, anchor LIMIT 15",
    "redirect_trace": f"WITH RECURSIVE {HOPS} SELECT * FROM tr",
    "canonical_audit": f"""WITH RECURSIVE {HOPS}, s AS (SELECT page_id // 3 AS site, 'u' || (page_id // 3 * 3 + 2) AS canonical, 'u' || page_id AS start FROM pages),
        a AS (SELECT site, CASE WHEN verdict IN ('loop_or_limit', 'broken_location') THEN verdict WHEN final_status <> 200 THEN 'non_200_final' WHEN start <> canonical AND redirect_count = 0 THEN 'variant_direct_200'
          WHEN final_url <> canonical THEN 'wrong_final_url' WHEN start = canonical AND redirect_count = 0 THEN 'canonical_200' WHEN redirect_count > 1 THEN 'redirect_chain' ELSE 'redirect_ok' END AS v FROM s JOIN tr USING (start)),
        o AS (SELECT site, count(*) FILTER (v NOT IN ('canonical_200', 'redirect_chain', 'redirect_ok')) AS failures, count(*) FILTER (v = 'redirect_chain') AS chains FROM a GROUP BY site)
        SELECT site, CASE WHEN failures > 0 THEN 'failure' WHEN chains > 0 THEN 'needs_chain_cleanup' ELSE 'healthy' END AS overall, failures, chains FROM o""",
    "log_bots": f"WITH {LOGS}, g AS (SELECT bot, count(*) AS hits, count(*) FILTER (has_params) AS p FROM b GROUP BY bot) SELECT bot, hits, {half_up('hits * 100.0 / sum(hits) OVER ()')} AS share_pct, {half_up('p * 100.0 / hits')} AS param_pct FROM g",
    "log_status": f"WITH {LOGS} SELECT bot, status, count(*) AS hits FROM b GROUP BY ALL",
    "log_daily": f"WITH {LOGS} SELECT day, count(*) AS hits, min(ts::DATE) AS date FROM b GROUP BY day",
    "log_top_paths": f"WITH {LOGS}, g AS (SELECT bot, path, count(*) AS hits FROM b GROUP BY ALL) SELECT bot, path, hits, row_number() OVER (PARTITION BY bot ORDER BY hits DESC, path) AS rank FROM g QUALIFY rank <= 10",
    "log_totals": f"WITH {LOGS} SELECT count(*) AS lines, count(*) FILTER (NOT parsed) AS unparsed, count(*) FILTER (parsed AND bot IS NOT NULL) AS bot_hits FROM l",
    "drift_rankings": f"WITH {RANKS} SELECT coalesce(old.keyword, new.keyword) AS keyword, old.position AS was, new.position AS now, CASE WHEN old.position IS NULL THEN 'gained' WHEN new.position IS NULL THEN 'lost' WHEN old.position > new.position THEN 'up' WHEN old.position < new.position THEN 'down' ELSE 'same' END AS change, old.position - new.position AS delta FROM old FULL JOIN new ON old.keyword = new.keyword",
    "drift_stats": f"WITH {RANKS} SELECT count(*) FILTER (old.position IS NULL) AS gained, count(*) FILTER (new.position IS NULL) AS lost, count(*) FILTER (old.position > new.position) AS up, count(*) FILTER (old.position < new.position) AS down, count(*) FILTER (old.position = new.position) AS same FROM old FULL JOIN new ON old.keyword = new.keyword",
    "drift_scores": "WITH a AS (SELECT o_orderpriority AS k, count(*)::DOUBLE AS v FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*)::DOUBLE AS v FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1) SELECT a.k AS pillar, a.v AS was, b.v AS now, b.v - a.v AS delta FROM a JOIN b ON a.k = b.k WHERE a.v <> b.v",
    "health_trend": f"WITH h AS (SELECT date_part('week', ts)::INT AS snap, ['technical', 'content', 'authority', 'cwv', 'ai_search'][user_id % 5 + 1] AS pillar, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL), g AS (SELECT snap, round_even(sum(v * CASE pillar WHEN 'technical' THEN 30 WHEN 'content' THEN 25 WHEN 'authority' THEN 20 WHEN 'cwv' THEN 15 ELSE 10 END) / 100, 1) AS health FROM h GROUP BY snap) SELECT 'site' AS domain, snap, health, row_number() OVER (ORDER BY snap DESC) AS back, health - lag(health) OVER (ORDER BY snap) AS step FROM g",
    "forecast": f"WITH {RANKS} SELECT old.keyword, old.volume, new.position, CASE WHEN new.position IS NULL THEN 0 ELSE CAST(round_even(old.volume * {CTR.format(p='new.position')}, 0) AS BIGINT) END AS now_clicks, CAST(round_even(old.volume * 0.08::DOUBLE * 0.6::DOUBLE, 0) AS BIGINT) AS low, CAST(round_even(old.volume * 0.08::DOUBLE, 0) AS BIGINT) AS expected, CAST(round_even(old.volume * 0.08::DOUBLE * 1.4::DOUBLE, 0) AS BIGINT) AS high, greatest(0, CAST(round_even(old.volume * 0.08::DOUBLE, 0) AS BIGINT) - CASE WHEN new.position IS NULL THEN 0 ELSE CAST(round_even(old.volume * {CTR.format(p='new.position')}, 0) AS BIGINT) END) AS uplift FROM old LEFT JOIN new ON old.keyword = new.keyword",
    "rank_loss": f"WITH {SUPS}, j AS (SELECT old.supplier, old.keyword, old.position AS was, old.volume, new.position AS now FROM old LEFT JOIN new ON old.supplier = new.supplier AND old.keyword = new.keyword), k AS (SELECT *, CASE WHEN now IS NULL THEN CASE WHEN was <= 10 THEN 'high' ELSE 'medium' END WHEN now - was >= 10 THEN 'high' ELSE 'medium' END AS severity FROM j WHERE was <= 20 AND (now IS NULL OR now - was >= 5)) SELECT supplier, keyword, was, volume, now, severity, CAST(round_even(volume * {CTR.format(p='was')}, 0) AS BIGINT) AS clicks_at_risk, row_number() OVER (PARTITION BY supplier ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, was, keyword) AS rank FROM k QUALIFY rank <= 10",
    "rank_recovery": f"WITH {SUPS} SELECT old.supplier, old.keyword, old.position AS was, new.position AS now FROM old JOIN new ON old.supplier = new.supplier AND old.keyword = new.keyword WHERE new.position <= old.position",
    "competitor_gain": f"WITH {SUPS}, g AS (SELECT supplier AS competitor, keyword FROM new WHERE supplier IN (SELECT supplier FROM old) AND (supplier, keyword) NOT IN (SELECT supplier, keyword FROM old)) SELECT competitor, count(*) AS gained, array_to_string(list_sort(list(keyword))[1:10], '|') AS examples FROM g GROUP BY 1 HAVING count(*) >= 3",
    "impact_asof": "WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT c.*, v.value AS before FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts), a AS (SELECT c.event_id, v.value AS after FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts < v.ts) SELECT event_id, user_id, before, after, CASE WHEN before IS NULL OR after IS NULL THEN 'insufficient_data' WHEN before - after > 0.95::DOUBLE THEN 'improved' WHEN before - after < -0.95::DOUBLE THEN 'worse' ELSE 'no_change' END AS verdict FROM b JOIN a USING (event_id)",
    "rec_ids": "SELECT page_id, left(sha1('example.com|' || url || '|lint|' || lower('Rule-' || (page_id % 7))), 12) AS rec_id FROM pages",
    "rec_priority": "WITH p AS (SELECT page_id, ['critical', 'high', 'medium', 'low'][page_id % 4 + 1] AS s, ['high', 'medium', 'low'][page_id % 3 + 1] AS c, (page_id * 37 % 2000)::DOUBLE AS clicks, page_id % 2 = 0 AS auto, page_id % 9 AS n FROM pages) SELECT page_id, floor(greatest(CASE s WHEN 'critical' THEN 5.0::DOUBLE WHEN 'high' THEN 4.0::DOUBLE WHEN 'medium' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, CASE WHEN clicks > 1 THEN least(5.0::DOUBLE, 1 + log10(clicks)) ELSE 0.0::DOUBLE END) * CASE c WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END * CASE WHEN auto THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END * least(1 + 0.1::DOUBLE * (greatest(n, 1) - 1), 1.5::DOUBLE) * 100 + 0.5) / 100 AS priority FROM p",
    "rec_replay": f"WITH {RECS} SELECT * FROM st",
    "rec_summary": f"WITH {RECS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("open", "accepted", "done", "ignored", "resolved")) + ", " + ", ".join(f"count(*) FILTER (status IN ('open', 'accepted') AND severity = '{s}') AS actionable_{s}" for s in ("critical", "high", "medium", "low")) + ", count(*) FILTER (status IN ('open', 'accepted')) AS actionable FROM st",
    "rec_autoresolve": FOUND + " SELECT r.url, o.rule_id FROM (SELECT page_id, url FROM r) r CROSS JOIN (VALUES ('thin-content'), ('missing-h1'), ('title-too-long')) o(rule_id) WHERE (r.url, o.rule_id) NOT IN (SELECT r.url, f.rule_id FROM f JOIN r USING (page_id))",
    "cost_periods": f"WITH {LEDGER} SELECT sum(CASE WHEN now - ts <= 86400 THEN cost ELSE 0 END)::DOUBLE AS today, sum(CASE WHEN now - ts <= 604800 THEN cost ELSE 0 END)::DOUBLE AS week, sum(CASE WHEN now - ts <= 2592000 THEN cost ELSE 0 END)::DOUBLE AS month, sum(cost) AS all_time, count(*) AS calls FROM l, nw",
    "cost_by_command": f"WITH {LEDGER} SELECT command, sum(cost) AS cost, count(*) AS calls FROM l GROUP BY 1",
    "cache_fresh": f"WITH {LEDGER}, c AS (SELECT 'k' || event_id % 50 AS key, ['serp', 'volume', 'whois', 'ranked'][event_id % 4 + 1] AS command, ts AS created FROM l), m AS (SELECT key, command, max(created) AS created FROM c GROUP BY ALL) SELECT command, count(*) AS entries, count(*) FILTER (now - created <= CASE command WHEN 'serp' THEN 21600 WHEN 'volume' THEN 604800 WHEN 'whois' THEN 2592000 ELSE 86400 END) AS fresh_entries FROM m, nw GROUP BY command",
    "event_tail": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events QUALIFY back <= 5",
    "brand_mentions": "WITH c AS (SELECT conv_id, turn, text, instr(lower(text), 'the') AS p FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, p > 0 AS mentioned, CASE WHEN p > 0 THEN trim(substr(text, greatest(1, p - 80), p - greatest(1, p - 80) + 83)) END AS excerpt FROM c",
    "visibility_rate": f"WITH c AS (SELECT conv_id % 4 AS platform, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE instr(lower(text), 'the') > 0 END AS m FROM conversations WHERE role = 'assistant') SELECT platform, count(m) AS answered, count(*) FILTER (m) AS mentions, CASE WHEN count(m) > 0 THEN {half_up('count(*) FILTER (m) * 100.0 / count(m)')} END AS rate FROM c GROUP BY platform",
    "visibility_diff": "WITH c AS (SELECT conv_id, bool_or(instr(lower(text), 'the') > 0) FILTER (turn < 2) AS w, bool_or(instr(lower(text), 'and') > 0) FILTER (turn >= 1) AS n FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN NOT coalesce(w, false) AND coalesce(n, false) THEN 'gained' WHEN coalesce(w, false) AND NOT coalesce(n, false) THEN 'lost' WHEN coalesce(w, false) THEN 'kept' ELSE 'absent' END AS change FROM c",
    "meta_draft": r"WITH d AS (SELECT doc_id, CASE WHEN length(text) <= 155 THEN text ELSE regexp_replace(left(text, 155), '\s\S*$', '') END AS t FROM documents) SELECT doc_id, regexp_replace(t, '[ .,;:]+$', '') AS draft FROM d",
    "keyword_candidates": f"WITH {PAGES}, q AS (SELECT page_id, list_filter(regexp_extract_all(lower(coalesce(nullif(h1[1], ''), title)), '[A-Za-z0-9][A-Za-z0-9''-]*'), lambda w: w NOT IN ('the','a','an','and','or','for','with','to','of','in','on','your','our','best','guide','2025','2026')) AS w FROM r) SELECT page_id, nullif(array_to_string(w[1:4], ' '), '') AS keyword FROM q",
    "pr_gate": FOUND + ", a AS (SELECT s.page_id, score, coalesce(list(rule_id) FILTER (rule_id IS NOT NULL), []) AS rules FROM s LEFT JOIN f USING (page_id) GROUP BY ALL), b AS (SELECT page_id - 1 AS page_id, score AS before_score, rules AS was FROM a), j AS (SELECT a.page_id AS path, before_score, score AS after_score, list_sort(list_filter(rules, lambda x: NOT list_contains(coalesce(was, []), x) AND list_contains(['" + "', '".join(i for i, _, s, _ in RULES if s in ("critical", "high")) + "'], x))) AS new FROM a LEFT JOIN b USING (page_id)) SELECT path, before_score, after_score, array_to_string(list_filter([CASE WHEN after_score < 30 THEN 'below_min' END, CASE WHEN before_score - after_score > 5 THEN 'dropped' END, CASE WHEN len(new) > 0 THEN 'new_findings' END], lambda x: x IS NOT NULL), '|') AS reasons, array_to_string(new, '|') AS new_rules FROM j WHERE after_score < 30 OR before_score - after_score > 5 OR len(new) > 0",
}
SQL["forecast_totals"] = f"SELECT count(*) AS keywords, {', '.join(f'sum({c}) AS {c}' for c in ('now_clicks', 'low', 'expected', 'high', 'uplift'))} FROM ({SQL['forecast']})"

SQL["link_roles"] = f"WITH RECURSIVE {EDGES}{BFS}, g AS (SELECT page_id AS node, (SELECT count(*) FROM kn WHERE dst = page_id) AS i, (SELECT count(*) FROM e WHERE src = page_id) AS o FROM pages) SELECT g.node, CASE WHEN g.node = 0 THEN 'home' WHEN depth IS NULL THEN 'unreachable' WHEN o >= 3 THEN 'hub' ELSE 'page' END AS role, 5 + least(14.0::DOUBLE, sqrt(i) * 2.2::DOUBLE) AS size FROM g LEFT JOIN d ON d.node = g.node"

MARKS = ("__NEXT_DATA__", "_next/", "data-reactroot", "data-react-helmet", "ng-app", "ng-version", "data-v-", "__NUXT__", "_nuxt/", "__VUE__", "data-astro", "webpackJsonp", "gatsby", "sveltekit", "__sveltekit")
SHELLS = ('<div id="root"', '<div id="app"', '<div id="__next"', '<div id="__nuxt"', '<div id="svelte"')
SQL["spa_verdict"] = (
    f"WITH {PAGES}, q AS (SELECT page_id, CASE "
    + " ".join(f"WHEN contains(html, '{m}') THEN CASE WHEN contains(substr(html, instr(html, '{m}')), '</div>') AND len(regexp_extract_all(split_part(substr(html, instr(html, '{m}')), '</div>', 1), '[\\p{{L}}\\p{{N}}_]+')) < 10 THEN 3 ELSE 0 END" for m in SHELLS)
    + " ELSE 0 END AS shell, least(2, "
    + " + ".join(f"contains(html, '{m}')::INT" for m in MARKS)
    + r") AS marks, len(regexp_extract_all(visible, '[\p{L}\p{N}_]+')) AS words, length(html) > 10240 AS large, len(regexp_extract_all(html, '(?i)<a[\s>/]')) AS anchors, len(regexp_extract_all(html, '(?i)<script[\s>/]')) AS scripts FROM v),"
    " s AS (SELECT page_id, shell + marks + CASE WHEN words < 150 AND large THEN 2 ELSE 0 END + CASE WHEN anchors < 5 AND large THEN 1 ELSE 0 END + CASE WHEN scripts > 10 AND words < 100 THEN 1 ELSE 0 END AS spa_score FROM q)"
    " SELECT page_id, spa_score, CASE WHEN spa_score >= 4 THEN 'spa' WHEN spa_score >= 2 THEN 'maybe' ELSE 'static' END AS verdict, spa_score >= 2 AS should_render FROM s"
)

#: The test pages hold no headings below h1, forms, tables, times, authors, phone links or JSON-LD, so only these signals vary.
CTAS = (
    "get started", "sign up", "signup", "register", "buy now", "buy", "shop", "order", "book", "demo", "get a quote", "get quote", "quote",
    "contact", "call us", "call now", "phone", "download", "subscribe", "join", "try", "start free", "free trial", "add to cart",
    "add to basket", "checkout", "enquire", "enquiry", "apply", "claim", "get my", "schedule", "reserve", "submit", "send",
)
TYPES = (
    f"WITH {PAGES}, a AS (SELECT page_id, list_transform(regexp_extract_all(clean, '{LINK}', 2), lambda x: lower({squeeze(unesc(NOTAGS.format(t='x')))})) AS anchors FROM v),"
    " b AS (SELECT r.page_id, host, lower(url) AS url, lower(url || ' ' || title || ' ' || array_to_string(h1, ' ')) AS text, word_count, len(list_filter(anchors, lambda x: "
    + " OR ".join(f"contains(x, '{p}')" for p in CTAS)
    + ")) AS ctas FROM r JOIN a USING (page_id)), p AS (SELECT page_id, host, unnest(["
    r"{'type': 'product', 's': regexp_matches(url, '/(product|products|shop|store|p)/')::INT * 2 + regexp_matches(text, '\b(buy|shop|sale|price)\b')::INT},"
    r"{'type': 'comparison', 's': regexp_matches(text, '\b(vs\.?|versus|alternatives?|compare|comparison|best\s+\w+)')::INT * 4},"
    r"{'type': 'local', 's': regexp_matches(url, '/(location|locations|near-me|contact)/')::INT * 2},"
    r"{'type': 'tool', 's': regexp_matches(text, '\b(calculator|generator|checker|tool)\b')::INT * 3},"
    r"{'type': 'service', 's': regexp_matches(text, '\b(service|services|consulting|consultant|agency)\b')::INT * 2},"
    "{'type': 'article', 's': regexp_matches(url, '/(blog|article)/')::INT * 2},"
    "{'type': 'landing', 's': (ctas >= 2)::INT * 3 + (word_count > 0 AND word_count < 900)::INT}], recursive := true) FROM b),"
    " k AS (SELECT page_id, type, s, row_number() OVER (PARTITION BY page_id ORDER BY s DESC, type) AS rk, lead(s, 1, 0) OVER (PARTITION BY page_id ORDER BY s DESC, type) AS nx, lead(type) OVER (PARTITION BY page_id ORDER BY s DESC, type) AS second FROM p),"
    " ty AS (SELECT r.page_id, r.host, CASE WHEN s > 0 THEN type ELSE 'unknown' END AS page_type, CASE WHEN s >= 5 AND s - nx >= 2 THEN 'high' WHEN s >= 3 THEN 'medium' ELSE 'low' END AS confidence, s AS top_score, CASE WHEN nx > 0 THEN second END AS second_type FROM k JOIN r USING (page_id) WHERE rk = 1),"
    " tc AS (SELECT host, page_type, count(*) AS n, min(page_id) AS f FROM ty WHERE page_type <> 'unknown' GROUP BY ALL),"
    " dm AS (SELECT host, page_type AS dominant, n, sum(n) OVER (PARTITION BY host) AS classified, floor(n / sum(n) OVER (PARTITION BY host) * 100 + 0.5) / 100 AS share, row_number() OVER (PARTITION BY host ORDER BY n DESC, f) AS rk FROM tc),"
    " co AS (SELECT host, dominant, classified, share, CASE WHEN classified >= 5 AND share >= 0.6 THEN 'high' WHEN classified >= 3 AND share >= 0.4 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN share >= 0.6 THEN 'strong_consensus' WHEN share >= 0.4 THEN 'mixed' ELSE 'fragmented' END AS verdict FROM dm WHERE rk = 1)"
)
SQL["page_type"] = TYPES + " SELECT page_id, page_type, second_type, confidence, top_score FROM ty"
SQL["serp_consensus"] = TYPES + " SELECT host, dominant, classified, share, confidence, verdict FROM co"
SQL["serp_alignment"] = TYPES + ", al AS (SELECT page_id, page_type, dominant, CASE WHEN dominant IS NULL THEN 'unavailable' WHEN verdict = 'fragmented' THEN 'mixed' WHEN page_type = dominant THEN 'aligned' WHEN coalesce(second_type = dominant, false) THEN 'partially_aligned' ELSE 'mismatch' END AS status FROM ty LEFT JOIN co USING (host)) SELECT page_id, page_type, dominant, status, CASE status WHEN 'aligned' THEN 100 WHEN 'partially_aligned' THEN 70 WHEN 'mismatch' THEN 35 END AS alignment FROM al"

DRAFT = r"regexp_replace(CASE WHEN length({t}) <= 155 THEN {t} ELSE regexp_replace(left({t}, 155), '\s\S*$', '') END, '[ .,;:]+$', '')"
ESC = "replace(replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
SQL["patch_plan"] = (
    FOUND
    + f", j AS (SELECT f.page_id, rule_id, url, h1[1] AS h, {DRAFT.format(t="array_to_string(h1, ' ')")} AS m FROM f JOIN r USING (page_id) WHERE rule_id IN ('missing-canonical', 'missing-meta-description', 'missing-title', 'missing-viewport', 'missing-html-lang')),"
    + f" o AS (SELECT page_id, rule_id, CASE rule_id WHEN 'missing-canonical' THEN '<link rel=\"canonical\" href=\"' || {ESC.format(t='url')} || '\">' WHEN 'missing-viewport' THEN '<meta name=\"viewport\" content=\"width=device-width, initial-scale=1\">'"
    + f" WHEN 'missing-meta-description' THEN '<meta name=\"description\" content=\"' || {ESC.format(t="nullif(m, '')")} || '\">' WHEN 'missing-title' THEN '<title>' || {ESC.format(t="nullif(h, '')")} || '</title>' END AS patch FROM j)"
    + " SELECT page_id, rule_id, patch, patch IS NULL AS skipped FROM o"
)
CRUMBS = (
    "p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),"
    " nm AS (SELECT page_id, root, parts, list_transform(parts, lambda p: trim(translate(p, '-_', '  '))) AS names FROM p),"
    " i AS (SELECT page_id, list_transform(range(1, len(parts) + 1), lambda k: '{\"@type\":\"ListItem\",\"position\":' || (k + 1) || ',\"name\":\"' || CASE WHEN names[k] = '' THEN 'Page' ELSE array_to_string(list_transform(regexp_extract_all(lower(names[k]), '\\p{L}+|[^\\p{L}]+'), lambda w: upper(left(w, 1)) || substr(w, 2)), '') END || '\",\"item\":\"' || root || '/' || array_to_string(parts[1:k], '/') || '\"}') AS items, root FROM nm),"
    " cr AS (SELECT page_id, '{\"@context\":\"https://schema.org\",\"@type\":\"BreadcrumbList\",\"itemListElement\":[' || array_to_string(list_prepend('{\"@type\":\"ListItem\",\"position\":1,\"name\":\"Home\",\"item\":\"' || root || '\"}', items), ',') || ']}' AS breadcrumb FROM i)"
)
SQL["breadcrumb_json"] = "WITH " + CRUMBS + " SELECT * FROM cr"
SQL["patch_plan"] = (
    SQL["patch_plan"].replace(" SELECT page_id, rule_id, patch, patch IS NULL AS skipped FROM o", ", " + CRUMBS)
    + " SELECT page_id, rule_id, patch, patch IS NULL AS skipped FROM o UNION ALL SELECT page_id, rule_id, '<script type=\"application/ld+json\">' || breadcrumb || '</script>', false FROM f JOIN cr USING (page_id) WHERE rule_id = 'missing-breadcrumb-schema'"
)

SQL["near_dup_groups"] = (
    "WITH RECURSIVE pr AS (" + SQL["near_dup_pairs"] + "), hd AS (" + SQL["near_dup_classes"].replace("SELECT head, count(*) AS n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS head FROM s) GROUP BY head HAVING count(*) > 1", "SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS head FROM s")
    + "), ed AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), re(node, far) AS (SELECT DISTINCT head, head FROM hd UNION SELECT re.node, ed.b FROM re JOIN ed ON ed.a = re.far),"
    + " cl AS (SELECT node, min(far) AS class_id FROM re GROUP BY node) SELECT doc_id, head, class_id FROM hd JOIN cl ON node = head"
)

# the rules that need no fetch, worst first
LOCAL = [(n, i, s) for n, (i, _, s, _) in enumerate(RULES) if i not in ("page-not-https", "missing-csp", "missing-hsts")]
SQL["lint_full"] = (
    FOUND
    + ", ru AS (SELECT unnest(["
    + ", ".join(f"'{i}'" for _, i, _ in LOCAL)
    + "]) AS rule_id, unnest(["
    + ", ".join(str(1000 * list(WEIGHT).index(s) + n) for n, _, s in LOCAL)
    + f"]) AS place) SELECT lr.page_id, greatest(0, 100 - coalesce(sum(weight), 0)) AS score, {len(LOCAL)} AS rules_run, {len(LOCAL)} - count(rule_id) AS passed, count(rule_id) AS failed, coalesce(string_agg(rule_id, ',' ORDER BY place), '') AS fired"
    + " FROM lr LEFT JOIN (SELECT * FROM f JOIN ru USING (rule_id)) x USING (page_id) GROUP BY lr.page_id"
)
SQL["lint_annotations"] = FOUND + " SELECT r.url AS file, '::' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'notice' END || ' file=' || replace(replace(replace(r.url, '%', '%25'), ':', '%3A'), ',', '%2C') || ',title=' || rule_id || '::' || category || ' ' || rule_id AS line FROM f JOIN r USING (page_id)"
SQL["pr_summary"] = "SELECT path, '| ' || path || ' | ' || coalesce(before_score::VARCHAR, 'new') || ' | ' || after_score || ' | ' || CASE WHEN before_score IS NULL THEN '' WHEN after_score > before_score THEN '+' || (after_score - before_score) ELSE (after_score - before_score)::VARCHAR END || ' | ' || replace(reasons, '|', ', ') || ' |' AS line FROM (" + SQL["pr_gate"] + ")"
SQL["drift_chart"] = "SELECT upper(left(label, 1)) || substr(label, 2) AS label, value FROM (UNPIVOT (" + SQL["drift_stats"] + ") ON COLUMNS(*) INTO NAME label VALUE value)"
SQL["crawl_order"] = (
    f"WITH RECURSIVE {EDGES}, w(node, depth) AS (SELECT page_id, 0 FROM pages WHERE page_id = 0"
    " UNION SELECT kn.dst, w.depth + 1 FROM w JOIN kn ON kn.src = w.node WHERE w.depth < 40 AND w.node % 13 <> 5 AND NOT starts_with(w.node::VARCHAR, '7')),"
    " d AS (SELECT node, min(depth) AS depth, starts_with(node::VARCHAR, '7') AS b FROM w GROUP BY node)"
    " SELECT 'https://site.example/' || node AS url, depth, CASE WHEN b THEN NULL WHEN node % 13 = 5 THEN 404 ELSE 200 END AS status, b AS blocked_by_robots FROM d"
)
