"""DuckDB twins of the further queries."""

from pagelode.plans.oracle import BLANK, FOUND, LEDGER, RANK, RECS, RULES, WEIGHT, ZERO, SQL as BASE

SEC = "CAST(epoch(DATE '{d}') AS BIGINT)"


def sec(day):
    return SEC.format(d=day)


RATED = """
rk AS (
  SELECT y, l_suppkey AS supplier, l_partkey AS part, row_number() OVER (PARTITION BY y, l_suppkey ORDER BY q DESC, l_partkey) AS position
  FROM (SELECT year(l_shipdate) AS y, l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem WHERE year(l_shipdate) IN (1994, 1996, 1998) GROUP BY ALL)
)"""
IMPACT = f"""
WITH {RATED},
sn AS (SELECT supplier AS domain, CAST(epoch(make_date(y::INT, 12, 31)) AS BIGINT) AS ts, part, 'u' || (part % 50) AS url, position FROM rk WHERE y = 1998 OR supplier % 13 <> 0),
rc AS (
  SELECT supplier AS domain, part AS id, CASE WHEN part % 7 = 1 THEN '' ELSE 'u' || (part % 50) END AS url, ['open', 'accepted', 'done', 'ignored', 'resolved'][part % 5 + 1] AS status,
    {sec("1996-07-01")} + part * 37 % 1000 * 86400 AS updated, part % 3 <> 0 AS keyed, position AS was, CASE WHEN part % 4 <> 0 THEN position + part % 11 END AS now
  FROM rk WHERE y = 1996
), c AS (SELECT * FROM rc WHERE status IN ('done', 'resolved') AND updated >= {sec("1999-06-01")} - 1000 * 86400),
t AS (SELECT DISTINCT domain, ts FROM sn),
b AS (SELECT c.domain, c.id, max(t.ts) FILTER (t.ts <= updated) AS b, min(t.ts) FILTER (t.ts > updated) AS a FROM c LEFT JOIN t USING (domain) GROUP BY ALL),
pg AS (SELECT domain, ts, url, avg(position) AS m FROM sn GROUP BY ALL),
j AS (
  SELECT c.*, b.b, b.a, sn.position, pb.m AS mb, pa.m AS ma FROM c JOIN b USING (domain, id)
  LEFT JOIN sn ON sn.domain = c.domain AND sn.ts = b.a AND sn.part = c.id AND keyed
  LEFT JOIN pg pb ON pb.domain = c.domain AND pb.ts = b.b AND pb.url = c.url LEFT JOIN pg pa ON pa.domain = c.domain AND pa.ts = b.a AND pa.url = c.url
), r AS (
  SELECT domain, id, updated AS completed,
    CASE WHEN b IS NULL OR a IS NULL THEN 'insufficient_data'
      WHEN keyed THEN CASE WHEN position IS NULL THEN CASE WHEN now IS NULL THEN 'no_change' ELSE 'worse' END WHEN position < coalesce(now, was) THEN 'improved' WHEN position > coalesce(now, was) THEN 'worse' ELSE 'no_change' END
      WHEN url = '' OR mb IS NULL AND ma IS NULL THEN 'insufficient_data'
      WHEN coalesce(mb, 999) - coalesce(ma, 999) > 0.95::DOUBLE THEN 'improved' WHEN coalesce(mb, 999) - coalesce(ma, 999) < -0.95::DOUBLE THEN 'worse' ELSE 'no_change' END AS verdict
  FROM j
)"""

STATE = (
    "ru AS (SELECT unnest([" + ", ".join(f"'{i}'" for i, *_ in RULES) + "]) AS rule_id, unnest(range(" + str(len(RULES)) + ")) AS n), "
    "st AS (SELECT url, rule_id, n, page_id, ['open', 'accepted', 'done', 'ignored', 'resolved'][(page_id + n) % 5 + 1] AS status FROM pages, ru WHERE (page_id + n) % 3 <> 0), "
)
SAVED = (
    FOUND
    + ", "
    + STATE
    + "fd AS (SELECT r.url, f.rule_id FROM f JOIN r USING (page_id)), "
    "ev AS (SELECT fd.url, fd.rule_id, 'raise' AS event, CASE WHEN status IS NULL THEN 'rec_raised' WHEN status IN ('done', 'resolved') THEN 'rec_reopened' ELSE 'raised_again' END AS kind, CASE WHEN status IS NULL OR status IN ('done', 'resolved') THEN 'open' ELSE status END AS status FROM fd LEFT JOIN st USING (url, rule_id)"
    " UNION ALL SELECT url, rule_id, 'status', 'rec_status', 'resolved' FROM st WHERE status IN ('open', 'accepted') AND (url, rule_id) NOT IN (SELECT url, rule_id FROM fd))"
)

# the log as a fold over events in order, an id at a time
DETAILS = (
    f"WITH {RECS}, dx AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'why ' || seq % 7 END AS w, seq % 5 = 0 AS auto, CASE WHEN seq % 4 = 1 THEN 'note ' || seq % 9 END AS note FROM k),"
    " dd AS (SELECT id, coalesce(arg_max(w, seq) FILTER (raised AND w IS NOT NULL), NULL) AS why, arg_max(auto, seq) FILTER (raised) AS auto_fixable, arg_max(note, seq) FILTER (NOT raised AND note IS NOT NULL) AS last_note FROM dx GROUP BY id)"
)

REPEATS = (
    "WITH "
    + RANK.format(name="o", year=1998)
    + ","
    + RANK.format(name="n", year=1999)
    + ", old AS (SELECT keyword, position + CASE WHEN position % 3 = 0 THEN 5 ELSE 0 END AS position FROM o), new AS (SELECT keyword, position + CASE WHEN position % 3 = 0 THEN 5 ELSE 0 END AS position FROM n)"
)

CELLS = "ce AS (SELECT s_suppkey // 20 AS grp, s_suppkey AS k, replace(s_name, '#', ' ') AS name FROM supplier)"
SEARCH = f"""WITH {CELLS}, it AS (
  SELECT grp, k, name, CASE WHEN k % 20 = 7 THEN 'ai_overview' WHEN k % 5 = 4 THEN 'people_also_ask' ELSE 'organic' END AS kind,
    CASE WHEN k % 20 = 13 THEN '' ELSE 'https://s.example' || ['/blog/', '/shop/', '/contact/', '/x/', '/tool/'][grp % 5 + 1] || (k - k % 2) END AS url, 'Item ' || (k - k % 4) AS title
  FROM ce
), og AS (SELECT grp, url, title, min(k) AS place FROM it WHERE kind = 'organic' GROUP BY ALL)"""
TYPED = (
    SEARCH
    + r""", sc AS (
  SELECT grp, place, unnest([
    {'type': 'article', 's': contains(url, '/blog/')::INT * 2}, {'type': 'product', 's': contains(url, '/shop/')::INT * 3}, {'type': 'local', 's': contains(url, '/contact/')::INT * 2},
    {'type': 'tool', 's': contains(url, '/tool/')::INT * 3}], recursive := true) FROM og
), ty AS (SELECT grp, place, arg_max(type, s) AS page_type FROM sc WHERE s > 0 GROUP BY ALL),
tc AS (SELECT grp, page_type, count(*) AS n, min(place) AS f FROM ty GROUP BY ALL),
dm AS (SELECT grp, page_type AS dominant, sum(n) OVER (PARTITION BY grp) AS classified, n, row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) AS rk FROM tc),
co AS (SELECT grp, dominant, classified, floor(n / classified * 100 + 0.5) / 100 AS share FROM dm WHERE rk = 1),
cv AS (SELECT *, CASE WHEN classified >= 5 AND share >= 0.6 THEN 'high' WHEN classified >= 3 AND share >= 0.4 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN share >= 0.6 THEN 'strong_consensus' WHEN share >= 0.4 THEN 'mixed' ELSE 'fragmented' END AS verdict FROM co)"""
)

PLACES = (
    ("uk", "United Kingdom"), ("u.k.", "United Kingdom"), ("gb", "United Kingdom"), ("great britain", "United Kingdom"), ("britain", "United Kingdom"), ("usa", "United States"), ("u.s.a.", "United States"),
    ("us", "United States"), ("u.s.", "United States"), ("america", "United States"), ("united states of america", "United States"), ("uae", "United Arab Emirates"),
    (" U.K. ", "United Kingdom"), ("USA", "United States"), ("France", "France"), (" paris", " paris"), ("", ""),
)

INTS = (
    ("duplicate_ids", 3), ("empty_buttons", 4), ("empty_links", 5), ("form_inputs_unlabelled", 2), ("generic_link_texts", 6), ("heading_skips", 7), ("iframes_missing_title", 3), ("positive_tabindex", 5),
    ("tables_without_th", 8), ("word_count", 1700), ("cta_count", 11), ("form_fields_max", 9), ("tel_links", 3), ("trust_signal_count", 4), ("cta_above_fold", 5), ("urgency_signal_count", 2), ("h1_count", 4),
    ("h2_count", 5), ("images_missing_alt", 4), ("internal_link_count", 7), ("external_link_count", 4), ("meta_description_length", 230), ("title_length", 90), ("schema_blocks", 3), ("mixed_content_count", 2),
    ("first_h2_para_words", 220), ("list_count", 3), ("images_total", 6), ("time_elements", 2),
)
BOOLS = (("has_main", 2), ("has_nav", 3), ("has_skip_link", 5), ("form_has_captcha", 4), ("primary_cta_generic", 3), ("faq_present", 2), ("noindex", 19), ("has_viewport", 7), ("security_csp", 2), ("security_hsts", 3), ("has_rel_author", 6), ("jsonld_has_dates", 5))
MADE = (
    "WITH m AS (SELECT p_partkey AS k, "
    + ", ".join(f"CASE WHEN p_partkey % {17 + n} <> 0 THEN p_partkey * {n + 3} % {m} END AS {c}" for n, (c, m) in enumerate(INTS))
    + ", "
    + ", ".join(f"CASE WHEN p_partkey % {23 + n} <> 0 THEN p_partkey % {m} = 0 END AS {c}" for n, (c, m) in enumerate(BOOLS))
    + """, CASE p_partkey % 3 WHEN 0 THEN '/p' WHEN 1 THEN 'https://a/p' ELSE '' END AS canonical, CASE WHEN p_partkey % 41 = 0 THEN 404 ELSE 200 END AS status,
    CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 30 / 10 END AS js_content_ratio, CASE WHEN p_partkey % 2 = 0 THEN 'HTTPS://a/p' ELSE 'http://a/p' END AS url, """
    + ", ".join(f"CASE WHEN p_partkey % {m} <> 0 THEN repeat('x', (p_partkey % {n})::INT) END AS {c}" for c, m, n in (("html_lang", 4, 3), ("meta_description", 5, 2), ("title", 6, 3), ("og_title", 3, 2), ("twitter_card", 7, 2)))
    + """, CASE WHEN p_partkey % 6 <> 0 THEN list_slice([['Article', 'WebPage', 'article'][p_partkey % 3 + 1], ['Organization', 'Offer'][p_partkey % 2 + 1], ['BreadcrumbList', 'Product', 'Person', 'FAQPage', 'WebSite'][p_partkey % 5 + 1]], 1, p_partkey % 4) END AS schema_types,
    p_partkey % 5 < 2 AS asks, p_partkey % 8 = 0 AS authored, p_partkey % 23 / 2 AS number_density FROM part)"""
)
FIRED = MADE + ", x AS (" + " UNION ALL ".join(f"SELECT k, '{i}' AS id, '{c}' AS category, {WEIGHT[s]} AS w, {list(WEIGHT).index(s)} AS rank, {n} AS ord FROM m WHERE {q}" for n, (i, c, s, q) in enumerate(RULES)) + ")"


def bit(condition):
    return f"CASE WHEN {condition} THEN '1' ELSE '0' END"


HAS = "coalesce(list_contains(list_transform(schema_types, lambda x: lower(x)), '{0}'), false)"
CONDITIONS = (
    BLANK.format("title"), ZERO.format("word_count"), "title_length IS NULL", "coalesce(len(schema_types), 0) > 0", "status = 200", "status <> 200", "coalesce(has_main, false)", "NOT coalesce(has_main, false)", "true", "false",
    "length(coalesce(html_lang, '')) < 2", "length(coalesce(html_lang, '')) > 1", "coalesce(word_count, 0) < 500", "coalesce(word_count, 0) > 500", "coalesce(word_count, 0) >= 500", "coalesce(word_count, 0) <= 500",
    "contains(canonical, 'https')", "NOT contains(canonical, 'https')", HAS.format("article"), "NOT " + HAS.format("organization"), "starts_with(lower(url), 'https')", "coalesce(len(schema_types), 0) < 2", "false", "true",
)

#: Criterion, most points, points; fields are filled with 0, '' and false.
LADDER = (
    ("answer_block", 20, "CASE WHEN p BETWEEN 40 AND 170 THEN 20 WHEN p > 170 THEN 12 WHEN p > 0 THEN 8 ELSE 0 END"),
    ("question_headings", 10, "CASE WHEN asks THEN 10 ELSE 0 END"),
    ("author", 10, "CASE WHEN authored OR coalesce(has_rel_author, false) OR list_contains(t, 'Person') THEN 10 ELSE 0 END"),
    ("dates", 10, "CASE WHEN coalesce(jsonld_has_dates, false) OR coalesce(time_elements, 0) > 0 THEN 10 ELSE 0 END"),
    ("outbound", 10, "CASE WHEN e >= 2 THEN 10 WHEN e >= 1 THEN 6 ELSE 0 END"),
    ("editorial_schema", 10, "CASE WHEN list_has_any(t, ['Article', 'BlogPosting', 'NewsArticle']) THEN 10 WHEN len(t) > 0 THEN 4 ELSE 0 END"),
    ("structure", 10, "CASE WHEN h >= 3 THEN 6 WHEN h >= 1 THEN 3 ELSE 0 END + CASE WHEN coalesce(list_count, 0) >= 1 THEN 4 ELSE 0 END"),
    ("depth", 10, "CASE WHEN w >= 1500 THEN 10 WHEN w >= 800 THEN 7 WHEN w >= 400 THEN 4 ELSE 0 END"),
    ("factual_density", 5, "CASE WHEN number_density >= 8 THEN 5 WHEN number_density >= 3 THEN 2.5 ELSE 0 END"),
    ("image_access", 5, "CASE WHEN i = 0 OR a = 0 THEN 5 WHEN a < i THEN 2 ELSE 0 END"),
    ("indexation", 5, "CASE WHEN canonical <> '' THEN 5 ELSE 2.5 END"),
)
LADDER_SQL = (
    MADE
    + ", f AS (SELECT *, coalesce(first_h2_para_words, 0) AS p, coalesce(external_link_count, 0) AS e, coalesce(h2_count, 0) AS h, coalesce(word_count, 0) AS w, coalesce(images_total, 0) AS i, coalesce(images_missing_alt, 0) AS a, coalesce(schema_types, []) AS t FROM m), c AS (SELECT k, CASE WHEN status <> 200 THEN 'status' WHEN coalesce(noindex, false) THEN 'noindex' END AS gate, "
    + ", ".join(f"CAST({q} AS DOUBLE) AS {n}" for n, _, q in LADDER)
    + " FROM f), s AS (SELECT *, CASE WHEN gate IS NOT NULL THEN 0 ELSE CAST(round_even("
    + " + ".join(n for n, *_ in LADDER)
    + ", 0) AS INTEGER) END AS score FROM c) SELECT k, gate, score, CASE WHEN score >= 80 THEN 'Citation ready' WHEN score >= 60 THEN 'Nearly ready' WHEN score >= 40 THEN 'Needs work' ELSE 'Not ready' END AS grade, CASE WHEN gate IS NULL THEN "
    + " || '|' || ".join(f"'{n}:' || {n} || CASE WHEN {n} >= {most} THEN ':pass' WHEN {n} > 0 THEN ':partial' ELSE ':fail' END" for n, most, _ in LADDER)
    + " END AS criteria FROM s"
)

K = "p_partkey"
FEATURES = {
    "title": f"'Page ' || {K}", "meta_description": f"CASE WHEN {K} % 3 = 1 THEN 'About things' ELSE '' END", "meta_description_length": f"CASE WHEN {K} % 3 = 1 THEN 12 ELSE 0 END",
    "meta_author": f"CASE WHEN {K} % 7 = 1 THEN 'Ann' ELSE '' END", "canonical": f"CASE WHEN {K} % 8 = 1 THEN '/p' ELSE '' END",
    "h1": f"repeat('|Alpha|beta', ({K} % 3)::INT)[2:]", "h1_count": f"{K} % 3 * 2", "h2": f"CASE WHEN {K} % 2 = 1 THEN 'How it works' ELSE '' END", "h2_count": f"{K} % 2", "list_count": f"{K} % 3", "time_elements": f"{K} % 2",
    "jsonld_has_dates": f"{K} % 10 = 1 OR {K} % 17 = 1", "has_rel_author": f"{K} % 9 = 1", "noindex": f"{K} % 6 = 1", "images_total": f"{K} % 4 + {K} % 3 * 2", "images_missing_alt": f"{K} % 3",
    "schema_blocks": f"({K} % 10 IN (1, 2))::INT", "schema_types": f"CASE WHEN {K} % 10 = 1 THEN 'Person|Article|FAQPage' ELSE '' END", "has_viewport": f"{K} % 2 = 0", "html_lang": f"CASE WHEN {K} % 3 <> 0 THEN 'en' ELSE '' END",
    "internal_link_count": f"({K} % 4 = 2)::INT + {K} % 4 + {K} % 2 + {K} % 3 + ({K} % 6 = 3)::INT", "external_link_count": f"{K} % 3",
    "first_h2_para_words": f"CASE WHEN {K} % 2 = 1 THEN 3 ELSE 0 END", "first_h2_para_text": f"CASE WHEN {K} % 2 = 1 THEN 'one two three' ELSE '' END", "og_title": f"CASE WHEN {K} % 4 = 1 THEN 'O' ELSE '' END", "twitter_card": f"CASE WHEN {K} % 5 = 1 THEN 'summary' ELSE '' END",
    "mixed_content_count": f"({K} % 9 = 1)::INT + {K} % 3", "form_inputs_unlabelled": f"({K} % 3 = 0)::INT", "has_skip_link": f"{K} % 4 = 2", "has_main": f"{K} % 5 <> 2", "has_nav": f"{K} % 3 <> 2",
    "heading_skips": f"({K} % 4 = 3)::INT", "duplicate_ids": f"greatest({K} % 4 - 1, 0) ", "empty_links": f"{K} % 2", "empty_buttons": f"{K} % 3", "generic_link_texts": f"{K} % 4", "tables_total": f"{K} % 3 + {K} % 2", "tables_without_th": f"{K} % 3",
    "iframes_total": f"{K} % 2 + {K} % 3", "iframes_missing_title": f"{K} % 2", "positive_tabindex": f"{K} % 2", "cta_count": f"({K} % 6 = 3)::INT + {K} % 3", "cta_texts": f"(CASE WHEN {K} % 6 = 3 THEN '|Call us' ELSE '' END || repeat('|Buy now', ({K} % 3)::INT))[2:]",
    "primary_cta_generic": "false", "form_count": f"({K} % 3 = 0)::INT", "form_fields_max": f"CASE WHEN {K} % 3 = 0 THEN 6 ELSE 0 END", "form_has_captcha": f"{K} % 13 = 1", "tel_links": f"({K} % 6 = 3)::INT",
    "trust_signal_count": f"{K} % 3", "urgency_signal_count": f"{K} % 2", "faq_present": f"{K} % 10 = 1", "live_chat": f"{K} % 11 = 1",
    "links": f"(CASE WHEN {K} % 4 = 2 THEN '|#main>Skip to content' ELSE '' END || repeat('|https://other.example/>Other', ({K} % 3)::INT) || repeat('|/in>Here', ({K} % 4)::INT) || repeat('|/e>', ({K} % 2)::INT) || repeat('|/e>', ({K} % 3)::INT) || CASE WHEN {K} % 6 = 3 THEN '|TEL:123>Call us' ELSE '' END)[2:]",
}

SQL = {
    "drift_sections": "WITH v AS (SELECT 'scores' AS section, o_orderpriority AS key, year(o_orderdate) AS y FROM orders UNION ALL SELECT 'backlinks', l_linestatus, year(l_shipdate) FROM lineitem UNION ALL SELECT 'mentions', l_returnflag, year(l_shipdate) FROM lineitem), g AS (SELECT section, key, y, count(*)::DOUBLE AS n FROM v GROUP BY ALL) SELECT a.section, a.key, a.n AS was, b.n AS now, b.n - a.n AS delta FROM g a JOIN g b ON a.section = b.section AND a.key = b.key AND a.y = 1997 AND b.y = 1998 WHERE a.n <> b.n",
    "cost_running": f"WITH {LEDGER}, d AS (SELECT command, ts // 86400 AS day, sum(cost)::BIGINT AS cost FROM l GROUP BY ALL) SELECT command, day, cost, sum(cost) OVER (PARTITION BY command ORDER BY day)::BIGINT AS total FROM d",
    "page_meta": f"SELECT {K} AS k, " + ", ".join(f"{FEATURES[c]} AS {c}" for c in ("meta_description", "og_title", "twitter_card", "meta_author", "noindex", "mixed_content_count")) + " FROM part",
    "patch_effect": f"WITH v AS (SELECT {K} AS k, unnest(['missing-viewport', 'missing-html-lang']) AS rule_id FROM part) SELECT k, rule_id, 1 AS solved, true AS no_worse FROM v WHERE CASE rule_id WHEN 'missing-viewport' THEN k % 2 <> 0 ELSE k % 3 = 0 END",
    "json_walk": "WITH c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 9 <> 0) SELECT conv_id, unnest(['$', '$.a', '$.b', '$.b[0]', '$.b[1]', '$.b[2]', '$.b[2].c']) AS path, unnest(['object', 'string', 'array', 'number', 'boolean', 'object', 'null']) AS kind, unnest([NULL, 'x' || conv_id, NULL, '1', 'true', NULL, NULL]) AS value FROM c",
    "near_dup_report": "SELECT a, b, round_even(similarity, 2) AS similarity FROM (" + BASE["near_dup_pairs"] + ")",
    "labels": "WITH u AS (SELECT page_id, 'site.example' || repeat('/part', (page_id % 13)::INT) || '?q=1' AS b, CASE WHEN page_id % 3 = 2 OR page_id % 13 = 0 THEN '' ELSE repeat('/part', (page_id % 13)::INT) END AS p FROM pages), s AS (SELECT *, CASE WHEN p = '' THEN '/' ELSE p END AS q FROM u) SELECT page_id, CASE WHEN length(b) > 48 THEN left(b, 47) || '…' ELSE b END AS short, CASE WHEN length(q) > 28 THEN left(q, 27) || '…' ELSE q END AS path, 'Missing h1 of ' || page_id AS name FROM s",
    "crawl_links": f"SELECT {K} AS k, ({K} % 4 = 2)::INT + {K} % 4 + {K} % 2 + {K} % 3 AS internal_link_count, {K} % 3 AS external_link_count, (CASE WHEN {K} % 4 = 2 THEN '|https://site.example/a>Skip to content' ELSE '' END || repeat('|https://site.example/in>Here', ({K} % 4)::INT) || repeat('|https://site.example/e>', ({K} % 2 + {K} % 3)::INT))[2:] AS internal FROM part",
    "loss_recs": "SELECT supplier, 'rank-loss-' || replace(keyword, ' ', '-') AS key, severity, CASE WHEN now IS NULL THEN 'Ranking lost: ' || chr(39) || keyword || chr(39) || ' (was ' || was || ')' ELSE 'Ranking dropped: ' || chr(39) || keyword || chr(39) || ' ' || was || ' → ' || now END AS finding FROM (" + BASE["rank_loss"] + ")",
    "recovered_recs": "SELECT supplier, keyword, was, now FROM (SELECT *, split_part(keyword, ' ', 2)::BIGINT AS p FROM (" + BASE["rank_recovery"] + ")) WHERE p % 2 = 0 AND p % 3 <> 2 AND p % 5 < 2 AND p % 7 <> 0",
    "search_console": f"SELECT {K} AS k, unnest(['q' || {K}, 'r']) AS query, unnest(['/p', NULL]) AS page, unnest([({K} % 9)::DOUBLE, NULL]) AS clicks, unnest([10::DOUBLE, NULL]) AS impressions, unnest([0.5::DOUBLE, NULL]) AS ctr, unnest([1.5::DOUBLE, NULL]) AS position FROM part WHERE {K} % 5 <> 0",
    "joined_links": f"SELECT {K} AS k, ['https://s.example/p/a', 'https://s.example/p/q/b?x=1', 'https://s.example/c', 'https://s.example/p/q/d/f', 'https://s.example/p/q/r' || {K} || '?y=2', 'https://s.example/p/q/r' || {K} || '?o=1', 'https://s.example/h/', 'https://o.example/i', 'mailto:m', 'https://s.example/p/q/', 'https://s.example/p/q/'][{K} % 11 + 1] AS target FROM part",
    "name_keys": f"SELECT {K} AS k, left(trim(regexp_replace(lower(' --' || p_name || '!? ' || {K} || ' and a rather long tail of words that is cut --'), '[^a-z0-9]+', '-', 'g'), '-'), 48) AS slug, 'shop' || {K} || '.example_x_y' AS domain, sha256('serp|' || p_name) AS key FROM part",
    "rec_normalised": f"WITH r AS (SELECT {K} AS k, CASE WHEN {K} % 3 <> 0 THEN 'u' || {K} % 9 ELSE '' END AS url, CASE WHEN {K} % 4 = 0 THEN 'Rule:x' ELSE 'manual' END AS source, ['high', 'medium', 'low', 'medium'][{K} % 4 + 1] AS severity, ['medium', 'low', 'medium'][{K} % 3 + 1] AS confidence, 'Finding ' || {K} % 5 AS finding FROM part) SELECT k, left(sha1('site.example|' || url || '|' || source || '|' || CASE WHEN k % 2 = 0 THEN 'key' ELSE lower(finding) END), 12) AS id, 'site.example' AS domain, url, source, severity, confidence, finding, 'general' AS category, false AS auto_fixable, 'open' AS status FROM r",
    "render_changes": f"WITH r AS (SELECT {K}, {K} % 90 + 10 AS raw_words, {K} % 90 + 10 + {K} % 60 AS rendered_words FROM part), q AS (SELECT *, floor(rendered_words / raw_words * 100 + 0.5) / 100 AS ratio FROM r) SELECT {K}, raw_words, rendered_words, ratio, CASE WHEN {K} % 3 = 0 THEN 'Product' ELSE '' END AS only_rendered, CASE WHEN ratio >= 1.5 THEN 'significant' ELSE 'minor' END AS verdict FROM q",
    "json_texts": "WITH c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 9 <> 0) SELECT conv_id, unnest([0, 1, 2, 3]) AS pos, unnest(['x' || conv_id, 'y' || conv_id, 'z', 'w']) AS value FROM c",
    "json_log": "SELECT event_type AS command, count(*) AS n, sum(event_id % 100 / 4) AS cost FROM events WHERE event_id % 7 <> 0 GROUP BY 1",
    "site_files": "SELECT (page_id % 50)::INT AS part, sum(len(regexp_extract_all(html, '(?i)<title'))) AS titles FROM pages GROUP BY 1",
    "submission_bodies": "SELECT count(DISTINCT url) AS urls, true AS within, 0 AS wrong FROM pages",
    "cost_windows": "WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark, min(ts)::DATE AS lo FROM events), d AS (SELECT unnest(generate_series(lo + 1, mark::DATE, INTERVAL 1 DAY)) AS until, mark FROM m) SELECT strftime(until, '%Y-%m-%d') AS until, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cost, count(*) AS calls FROM d JOIN events ON ts < until AND ts >= until - INTERVAL 7 DAY WHERE until <= mark GROUP BY 1",
    "page_features": f"SELECT {K} AS k, " + ", ".join(f"{q} AS {c}" for c, q in FEATURES.items()) + " FROM part",
    # elements up to each action, counted from the body on, against all of them
    "fold_position": f"WITH p AS (SELECT {K} AS k, 1 + {K} % 7 AS a, 1 + {K} % 7 + {K} % 5 + 2 AS b, 1 + {K} % 7 + {K} % 5 + 2 + {K} % 11 AS n FROM part) SELECT k, 2 AS cta_count, (a / n < 0.4::DOUBLE)::INT + (b / n < 0.4::DOUBLE)::INT AS cta_above_fold FROM p",
    "impact_report": IMPACT + " SELECT domain, id, completed, verdict, list_position(['improved', 'worse', 'no_change', 'insufficient_data'], verdict)::INT AS rank FROM r",
    "impact_counts": IMPACT + " SELECT domain, count(*) AS evaluated, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ("improved", "worse", "no_change", "insufficient_data")) + " FROM r GROUP BY domain",
    "lint_save": SAVED + " SELECT (SELECT count(*) FROM ev WHERE event = 'raise') AS raised, (SELECT count(*) FROM ev WHERE kind = 'rec_reopened') AS reopened, (SELECT count(*) FROM ev WHERE kind = 'rec_status') AS resolved, (SELECT count(*) FROM (SELECT coalesce(ev.status, st.status) AS s FROM st FULL JOIN ev ON st.url = ev.url AND st.rule_id = ev.rule_id) WHERE s IN ('open', 'accepted')) AS open_total",
    "lint_save_events": SAVED + " SELECT * FROM ev",
    "rec_details": DETAILS + " SELECT id, st.status, why, auto_fixable, last_note FROM st JOIN dd USING (id)",
    "rec_fixable": DETAILS + " SELECT count(*) AS total, count(*) FILTER (st.status IN ('open', 'accepted')) AS actionable, count(*) FILTER (st.status IN ('open', 'accepted') AND auto_fixable) AS auto_fixable_open FROM st JOIN dd USING (id)",
    "rec_list": f"WITH {RECS} SELECT 'open' AS list, id, status, severity FROM st WHERE status NOT IN ('done', 'ignored', 'resolved') UNION ALL SELECT 'done', id, status, severity FROM st WHERE status = 'done' UNION ALL SELECT 'high', id, status, severity FROM st WHERE severity = 'high'",
    "rec_history": f"WITH {RECS} SELECT id, seq, CASE WHEN raised THEN 'raise' ELSE 'status' END AS event, CASE WHEN raised THEN '' ELSE status END AS status FROM x WHERE id = 7",
    "rec_wins": f"WITH {RECS} SELECT severity, row_number() OVER (PARTITION BY severity ORDER BY updated DESC, id) AS rank, id, status FROM st WHERE status IN ('done', 'resolved') QUALIFY rank <= 5",
    "drift_repeats": REPEATS + " SELECT coalesce(old.keyword, new.keyword) AS keyword, old.position AS was, new.position AS now, CASE WHEN old.position IS NULL THEN 'gained' WHEN new.position IS NULL THEN 'lost' WHEN old.position > new.position THEN 'up' WHEN old.position < new.position THEN 'down' ELSE 'same' END AS change, old.position - new.position AS delta FROM old FULL JOIN new ON old.keyword = new.keyword",
    "drift_moves": "SELECT * FROM (" + BASE["drift_rankings"] + ") WHERE change = 'up' ORDER BY abs(delta) DESC, keyword LIMIT 20",
    "watch_health": "WITH h AS (SELECT user_id % 50 AS site, ts::DATE AS d, round(avg(user_id), 1) AS health FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d DESC) AS n FROM h) SELECT a.site, a.health AS latest, b.health AS previous, round(a.health - b.health, 1) AS delta FROM r a LEFT JOIN r b ON a.site = b.site AND b.n = 2 WHERE a.n = 1",
    "cache_expired": f"WITH {LEDGER} SELECT command, count(*) AS n FROM l, nw WHERE now - ts > 7 * 86400 GROUP BY command",
    "payload_rankings": f"WITH {CELLS}, p AS (SELECT grp, CASE WHEN grp % 2 = 1 OR k % 6 <> 0 THEN name END AS keyword, CASE WHEN grp % 2 = 0 THEN CASE WHEN k % 3 <> 0 THEN k % 3 WHEN k % 9 <> 0 THEN k % 9 ELSE 0 END ELSE k % 50 END AS position, CASE WHEN grp % 2 = 0 THEN 'f' || k WHEN k % 5 <> 0 THEN 'n' || k ELSE 'c' || k END AS url, CASE WHEN grp % 2 = 0 THEN CASE WHEN k % 4 <> 0 THEN k * 10 END ELSE k * 7 END AS search_volume FROM ce) SELECT * FROM p WHERE keyword IS NOT NULL",
    "payload_backlinks": "SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 2 THEN NULL ELSE s_suppkey END AS referring_domains, CASE s_suppkey % 5 WHEN 0 THEN s_suppkey * 3 WHEN 1 THEN NULL WHEN 2 THEN s_suppkey ELSE 2 END AS backlinks FROM supplier WHERE s_suppkey % 5 <> 4",
    "payload_volumes": f"WITH {CELLS} SELECT name AS keyword, CASE WHEN k % 3 = 0 THEN 5 WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN k * 10 ELSE k * 9 END::DOUBLE AS volume FROM ce",
    "payload_errors": f"WITH {CELLS} SELECT DISTINCT grp, 40501 AS status_code, 'bad field' AS message FROM ce WHERE grp % 4 = 3",
    "ai_overviews": f"WITH {CELLS}, o AS (SELECT grp, k, name, array_to_string(list_sort(list_distinct(['d' || k % 3 || '.example', 'd' || k % 5 || '.example', 'd' || k % 4 || '.example'])), '|') AS d FROM ce WHERE k % 20 = 7) SELECT g.grp, o.grp IS NOT NULL AS present, CASE WHEN o.grp IS NOT NULL THEN name = 'Supplier 000000027' OR contains(d, 'd3.example') END AS mentioned, d AS cited_domains FROM (SELECT DISTINCT grp FROM ce) g LEFT JOIN o USING (grp)",
    "serp_nested": SEARCH + ", w AS (SELECT grp, unnest(range(1, grp % 14 + 1)) AS level FROM (SELECT DISTINCT grp FROM ce)) SELECT grp, (grp % 14 - level + 1)::INT AS nr, '/' || grp || '/' || level AS url FROM w UNION ALL SELECT grp, (grp % 14 + row_number() OVER (PARTITION BY grp ORDER BY k))::INT, url FROM it",
    "serp_features": SEARCH + " SELECT grp, kind AS feature, count(*) AS n FROM it WHERE kind <> 'organic' GROUP BY ALL",
    "serp_organic": SEARCH + " SELECT grp, url, title FROM og",
    "serp_types": TYPED + " SELECT grp, dominant, classified, share, confidence, verdict FROM cv",
    "sxo_mismatch": TYPED + ", f AS (SELECT *, ['article', 'tool', 'landing'][grp % 3 + 1] AS kind FROM cv WHERE verdict <> 'fragmented' AND confidence <> 'low') SELECT grp, 'page-type-' || CASE WHEN grp % 2 = 0 THEN 'best-word-' || grp ELSE dominant END AS rec_key, CASE WHEN kind = 'article' AND dominant IN ('product', 'tool', 'local') THEN 'critical' ELSE 'high' END AS severity, confidence, 'Page-type mismatch: ' || kind || ' page for ' || dominant || ' SERP' AS finding FROM f WHERE kind <> dominant",
    "locations": "SELECT c_custkey AS k, [" + ", ".join(f"'{x}'" for _, x in PLACES) + f"][c_custkey % {len(PLACES)} + 1] AS location FROM customer",
    "prompt_visible": "SELECT DISTINCT conv_id, CASE WHEN conv_id % 6 = 5 THEN conv_id % 4 = 0 ELSE conv_id % 3 = 0 OR conv_id % 5 = 0 OR conv_id % 2 = 0 AND conv_id % 7 = 0 END AS mentioned FROM conversations",
    "annotated_sources": "WITH c AS (SELECT DISTINCT conv_id AS i FROM conversations WHERE conv_id % 11 <> 0), l AS (SELECT i, unnest([i % 3, i % 4, i % 5]) AS s, unnest([0, 1, 2]) AS o FROM c), d AS (SELECT i, s, min(o) AS o FROM l GROUP BY ALL) SELECT i AS conv_id, (row_number() OVER (PARTITION BY i ORDER BY o) - 1)::INT AS pos, 'https://s' || s || '.example' AS url, 'T' || s AS title FROM d",
    "security_fields": "SELECT page_id, page_id % 13 <> 0 AND page_id % 2 = 0 AS security_hsts, page_id % 13 <> 0 AND page_id % 3 = 0 AS security_csp, page_id % 13 <> 0 AND page_id % 5 = 0 AS security_xfo, page_id % 13 <> 0 AND page_id % 7 = 0 AS security_xcto FROM pages",
    "sitemap_report": "WITH c AS (SELECT page_id, 'https://site.example/' || lpad(page_id::VARCHAR, 7, '0') AS u, CASE WHEN page_id % 4 = 0 THEN '/' ELSE '' END AS s, CASE WHEN page_id % 5 = 1 THEN 500 ELSE 200 END AS status FROM pages), a AS (SELECT * FROM c WHERE page_id % 2 = 0 AND page_id % 9 <> 4), b AS (SELECT u FROM c WHERE page_id % 3 <> 2), q AS (SELECT 'crawled_not_in_sitemap' AS kind, u AS url FROM a WHERE u NOT IN (SELECT u FROM b) UNION ALL SELECT 'sitemap_not_crawled', u FROM b WHERE u NOT IN (SELECT u FROM a) UNION ALL SELECT 'non_200_in_sitemap', u || s FROM a WHERE status <> 200 AND u IN (SELECT u FROM b)) SELECT kind, url FROM q QUALIFY row_number() OVER (PARTITION BY kind ORDER BY url) <= 50",
    "sitemap_urls": "SELECT page_id::VARCHAR AS source, 'https://c/' || page_id AS url FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id::VARCHAR, 'https://b/' || page_id FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id::VARCHAR, 'https://b/x' FROM pages WHERE page_id % 3 <> 0",
    "mixed_depths": "SELECT node, inlinks, 5 + least(14.0::DOUBLE, sqrt(inlinks) * 2.2::DOUBLE) AS size FROM (" + BASE["hubs_topk"].replace("LIMIT 15", "LIMIT 16") + ")",
    "report_figures": "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 3 THEN NULL WHEN s_suppkey % 4 = 2 THEN CASE WHEN s_suppkey % 130 < 100 THEN s_suppkey % 130 + 0.5::DOUBLE END WHEN s_suppkey % 130 <= 100 THEN (s_suppkey % 130)::DOUBLE END AS score, (s_suppkey % 3)::INT AS critical, (s_suppkey % 4)::INT AS high, (s_suppkey % 2)::INT AS medium, 1 AS low FROM supplier",
    "report_cells": r"WITH t AS (SELECT c_custkey AS k, 'a \| b c' || repeat(' xy', (c_custkey % 60)::INT) AS t FROM customer) SELECT k, CASE WHEN length(t) > 90 THEN rtrim(left(t, 89)) || '…' ELSE t END AS cell, '—' AS nothing, CASE WHEN k = 1 THEN '—' ELSE strftime(DATE '1970-01-01' + (k - 1)::INT, '%d %b %Y') END AS day, CASE WHEN k % 101 >= 70 THEN 'green' WHEN k % 101 >= 40 THEN 'amber' ELSE 'red' END AS colour FROM t",
    "profile_problems": "WITH p AS (SELECT s_suppkey AS client, list_filter([CASE WHEN s_suppkey % 2 = 1 THEN 'site.url is missing' END, CASE WHEN s_suppkey % 4 = 0 THEN 'competitors is empty' END, CASE WHEN s_suppkey % 3 = 0 THEN 'an entity has no name' END, CASE WHEN s_suppkey % 5 = 0 THEN 'an entity has no type' END], lambda x: x IS NOT NULL) AS l FROM supplier) SELECT client, array_to_string(l, '|') AS problems FROM p WHERE len(l) > 0",
    "submission_urls": "SELECT DISTINCT url FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0 OR page_id % 5 = 0",
    "entity_fields": "SELECT replace(s_name, '#', ' ') AS name, NULL::VARCHAR AS description, 'https://a,https://b' AS sameAs, 'https://site.example' AS url, NULL::VARCHAR AS jobTitle FROM supplier WHERE s_suppkey % 3 = 2 ORDER BY s_suppkey LIMIT 1",
    "pr_compare": FOUND + ", a AS (SELECT s.page_id, score, coalesce(list(rule_id) FILTER (rule_id IS NOT NULL), []) AS rules FROM s LEFT JOIN f USING (page_id) GROUP BY ALL), b AS (SELECT page_id - 1 AS page_id, score AS before_score, rules AS was FROM a) SELECT a.page_id AS path, before_score, score AS after_score, score - before_score AS delta, array_to_string(list_sort(list_filter(rules, lambda x: NOT list_contains(coalesce(was, []), x))), '|') AS new_rules, array_to_string(list_sort(list_filter(coalesce(was, []), lambda x: NOT list_contains(rules, x))), '|') AS fixed_rules FROM a LEFT JOIN b USING (page_id)",
    "lint_all_rules": FIRED + f" SELECT m.k, greatest(0, 100 - coalesce(sum(w), 0))::INT AS score, {len(RULES)} AS rules_run, {len(RULES)} - count(id) AS passed, count(id) AS failed, coalesce(string_agg(id, ',' ORDER BY rank, ord), '') AS fired FROM m LEFT JOIN x USING (k) GROUP BY m.k",
    "lint_categories": FIRED + ", g AS (SELECT k, category, n FROM m, (VALUES ('cro', " + str(sum(r[1] == "cro" for r in RULES)) + "), ('accessibility', " + str(sum(r[1] == "accessibility" for r in RULES)) + ")) c(category, n)) SELECT g.k, g.category, greatest(0, 100 - coalesce(sum(w), 0))::INT AS score, count(id) AS findings, any_value(n) AS rules FROM g LEFT JOIN x ON x.k = g.k AND x.category = g.category GROUP BY g.k, g.category",
    "lint_conditions": MADE + " SELECT k, " + " || ".join(bit(c) for c in CONDITIONS) + " AS fired FROM m",
    "citation_ladder": LADDER_SQL,
    "stream_daily": "WITH w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events) SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type AS type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS value FROM events, w WHERE ts::DATE + INTERVAL 1 DAY <= mark GROUP BY ALL",
    "stream_sessions": "WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events), g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS born FROM events), s AS (SELECT user_id, ts, sum(born) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g), e AS (SELECT user_id, no, count(*) AS n, max(ts) + INTERVAL 30 MINUTE AS stop FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM e, w WHERE stop <= mark GROUP BY user_id",
    "stream_replay": BASE["rec_replay"],
}

FETCHED = "WITH t AS (SELECT page_id AS i, 1 + page_id % 2 AS save, url, CASE WHEN page_id % 17 = 3 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 5 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type, html FROM pages)"
SQL["fetched_pages"] = FETCHED + " SELECT save, url, status, content_type, CASE WHEN i % 4 = 0 THEN url || '#end' ELSE url END AS final_url, length(html)::INT AS chars, CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END AS n_headers, i % 2 = 0 AS security_hsts, false AS security_csp FROM t"
SQL["fetched_stream"] = FETCHED + " SELECT save, status, content_type, count(*) AS n, sum(length(html))::BIGINT AS chars FROM t GROUP BY ALL"
SQL["lint_changed"] = (
    FOUND
    + ", lf AS (SELECT page_id, rule_id FROM f WHERE rule_id NOT IN ('page-not-https', 'missing-csp', 'missing-hsts')), nx AS (SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id + 1 IN (SELECT page_id FROM pages) THEN page_id + 1 ELSE page_id END AS source FROM pages),"
    " o AS (SELECT 'p/' || page_id AS path, rule_id FROM lf), n AS (SELECT 'p/' || nx.page_id AS path, rule_id FROM nx JOIN lf ON lf.page_id = source WHERE nx.page_id % 11 <> 5 UNION ALL SELECT 'new/' || page_id, rule_id FROM lf WHERE page_id % 13 = 1)"
    " SELECT path, rule_id, CASE WHEN o.rule_id IS NULL THEN 'new' WHEN n.rule_id IS NULL THEN 'fixed' ELSE 'carried' END AS state FROM (SELECT path, rule_id, 1 AS w FROM o) o FULL JOIN n USING (path, rule_id)"
).replace("CASE WHEN o.rule_id IS NULL THEN 'new' WHEN n.rule_id IS NULL THEN 'fixed'", "CASE WHEN w IS NULL THEN 'new' WHEN v IS NULL THEN 'fixed'").replace("FULL JOIN n USING", "FULL JOIN (SELECT path, rule_id, 1 AS v FROM n) n USING")
RESPONSES = "WITH b AS (SELECT event_id % 3 AS batch, event_type || '-' || user_id % 50 AS key, event_type AS command, 'body ' || event_id AS body, event_id % 100 / 4 AS cost, least(event_id % 150, 120) AS chars, floor(epoch(ts))::BIGINT AS ts FROM events)"
SQL["cache_latest"] = RESPONSES + " SELECT key, command, body, cost, ts FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, batch DESC, command DESC, body DESC) = 1"
SQL["cache_ledger"] = RESPONSES + " SELECT batch, command, count(*) AS n, sum(cost) AS cost, sum(chars)::BIGINT AS detail_chars FROM b GROUP BY ALL"
SQL["watch_runs"] = "SELECT 0::BIGINT AS batch, unnest(['backlinks', 'competitors', 'counts', 'users']) AS check_name, unnest(['failed', 'skipped', 'done', 'done']) AS state, unnest(['shape not recognised', NULL, NULL, NULL]) AS error WHERE EXISTS (SELECT 1 FROM events)"
SQL["watch_counts"] = "SELECT event_type, count(*) AS n, sum(trunc(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY event_type"
SQL["page_layout"] = (
    "WITH RECURSIVE pa AS (" + BASE["bfs_parents"] + "), dg AS (" + BASE["link_degree"] + "), un AS (" + BASE["unreachable"] + "),"
    " rk AS (SELECT pa.*, row_number() OVER (PARTITION BY parent ORDER BY inlinks DESC, node) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM pa JOIN dg USING (node) WHERE depth > 0),"
    " la(node, depth, centre, span) AS (SELECT node, depth, 2 * pi() / n * i, 2 * pi() / n * 0.9::DOUBLE FROM rk WHERE depth = 1 UNION ALL SELECT rk.node, rk.depth, centre - span / 2 + span / n * (i + 0.5::DOUBLE), span / n FROM la JOIN rk ON rk.parent = la.node),"
    " pl AS (SELECT node, depth, centre, 150 + 130 * depth AS radius FROM la UNION ALL SELECT node, 0, 0, 0 FROM pa WHERE depth = 0"
    " UNION ALL SELECT node, -1, 2 * pi() * (row_number() OVER (ORDER BY node) - 1) / count(*) OVER (), 150 + 130 * ((SELECT max(depth) FROM pa) + 1) FROM un)"
    " SELECT node, depth, 550 + radius * cos(centre) AS x, 550 + radius * sin(centre) AS y FROM pl"
)
SQL["stream_timeline"] = (
    "WITH RECURSIVE e AS (SELECT user_id AS id, event_id AS seq, floor(epoch(ts))::BIGINT AS ts, event_type IN ('error', 'view', 'signup') AS raised, ['open', 'accepted', 'done', 'ignored', 'resolved', 'bogus'][event_id % 6 + 1] AS given, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nr FROM events),"
    " w(id, nr, seq, ts, kind, status) AS (SELECT DISTINCT id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM e UNION ALL SELECT e.id, e.nr, e.seq, e.ts,"
    " CASE WHEN raised THEN CASE WHEN status IS NULL THEN 'rec_raised' WHEN status IN ('done', 'resolved') THEN 'rec_reopened' ELSE 'raised_again' END WHEN status IS NOT NULL AND given <> 'bogus' THEN 'rec_status' END,"
    " CASE WHEN raised THEN CASE WHEN status IS NULL OR status IN ('done', 'resolved') THEN 'open' ELSE status END WHEN status IS NOT NULL AND given <> 'bogus' THEN given ELSE status END"
    " FROM w JOIN e ON e.id = w.id AND e.nr = w.nr + 1) SELECT id, seq, ts, kind, status FROM w WHERE kind IS NOT NULL"
)
