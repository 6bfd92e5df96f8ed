"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from pagesieve.functions.text import WHITE_SPACE, WHITE_SPACE_CLASS
from pagesieve.operators.keyphrases import TOKEN
from pagesieve.operators.metrics import SPAM_BUCKETS
from pagesieve.registry.params import CRAWLED_AT, DICTIONARY, OPTIONS, STOP_WORDS
from pagesieve.sources.adapters import HIDDEN_HTML
from pagesieve.sources.dictionary import EXPLICIT_WEIGHTS


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_WS = lit(WHITE_SPACE)
_WS_CLASS = lit(WHITE_SPACE_CLASS + "+")

# --- page records --------------------------------------------------------------------------------------------------

PAGES = """
recs AS (
  SELECT *,
    CASE WHEN i % 50 = 0 THEN path WHEN i % 3 = 0 THEN ' HTTPS://' || upper(host) || path
         ELSE 'https://' || host || path END AS url,
    CASE WHEN i % 7 = 1 THEN '//Example.com/' || source || '?p=' || (i % 97)
         WHEN i % 7 = 2 THEN '/relative' ELSE '' END AS canonical_url,
    regexp_extract(text, '^[^.\\n]*', 0) AS title,
    regexp_extract(text, '\\n([^\\n]*)', 1) AS meta_description,
    CASE WHEN i % 2 = 0 THEN ['/about', '//' || host || '/x', 'https://' || host || path] ELSE ['/about'] END
      AS internal_links,
    CASE WHEN i % 3 <> 0 THEN ['HTTPS://Other.Example.org/Ä?b=C#', 'mailto:a@b'] END AS external_links,
    make_timestamp((1700000000 + i * 3600) * 1000000) AS date_published,
    (i % 4) * 1000000000 + i AS load_time,
    i % 2 = 0 AS is_secure
  FROM (SELECT doc_id AS i, CAST(doc_id AS VARCHAR) AS key, text, lang AS language, source,
               source || '.example.com' AS host, '/' || lang || '/' || doc_id AS path FROM documents)
)"""

HTML_PAGES = f"""
html_pages AS (
  SELECT CAST(page_id AS VARCHAR) AS key, page_id AS i, url,
    regexp_replace(html, {lit(HIDDEN_HTML)}, ' ', 'g') AS text,
    upper(regexp_extract(url, '^[^/]*//([^/?#]*)', 1)) AS host,
    regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs
  FROM pages
)"""


def signature(text: str) -> str:
    return f"sha256(trim(coalesce({text}, ''), {_WS}))"


def load_ms(ns: str) -> str:
    return f"CASE WHEN {ns} > 0 THEN {ns} // 1000000 ELSE 0 END"


# --- URLs ----------------------------------------------------------------------------------------------------------

_PATH_CHARS = r"A-Za-z0-9\-_.~$&+,/:;=@!''()*\[\]%"


def _encoded(part: str, ok: str, kept: str) -> str:
    return f"""CASE WHEN regexp_full_match({part}, '[{ok}]*') THEN {part} ELSE array_to_string(list_transform(
      string_split(url_decode({part}), ''),
      lambda c: CASE WHEN regexp_full_match(c, '[{kept}]') THEN c ELSE url_encode(c) END), '') END"""


def normalized(name: str, source: str) -> str:
    """A CTE with all columns of ``source`` and ``n``, its column ``u`` as a normalised URL or null."""
    keep_path, keep_fragment = r"A-Za-z0-9\-_.~$&+,/:;=@", r"A-Za-z0-9\-_.~$&+,/:;=@?!()*"
    plain_host = r"[\x21-\x24\x26-\x7e]"
    bad_escape = "regexp_matches({0}, '%([^0-9A-Fa-f]|$|.[^0-9A-Fa-f]|.$)')"
    stages = [
        [f"trim(coalesce(u, ''), {_WS}) AS s"],
        ["CASE WHEN starts_with(s, '//') THEN 'https:' || s ELSE s END AS a"],
        ["split_part(a, '#', 1) AS body"],
        [
            "substr(a, length(body) + 2) AS frag",
            "regexp_extract(body, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1) AS scheme",
        ],
        ["CASE WHEN scheme = '' THEN body ELSE substr(body, length(scheme) + 2) END AS rest"],
        ["split_part(rest, '?', 1) AS hier"],
        ["starts_with(hier, '//') AND scheme <> '' AS has_host", "substr(rest, length(hier) + 1) AS query"],
        ["CASE WHEN has_host THEN regexp_extract(hier, '^//([^/]*)', 1) ELSE '' END AS auth"],
        [
            "regexp_extract(auth, '^(.*@)', 1) AS usr",
            "CASE WHEN has_host THEN substr(hier, length(auth) + 3) ELSE hier END AS path_",
        ],
        [
            "substr(auth, length(usr) + 1) AS host_",
            "NOT has_host AND NOT starts_with(path_, '/') AS rootless",
        ],
        [
            f"""(rootless AND scheme = '' AND contains(split_part(path_, '/', 1), ':'))
              OR {bad_escape.format('frag')} OR (NOT (rootless AND scheme <> '') AND {bad_escape.format('path_')})
              OR {bad_escape.format('usr')}
              OR NOT regexp_full_match(usr, '[A-Za-z0-9\\-._:~!$&\'\'()*+,;=%@]*')
              OR NOT regexp_full_match(host_,
                '(\\[[0-9A-Fa-f:.]*\\]|([^\\x00-\\x20\\\\^`{{|}}%@\\[\\]:\\x7f]|%[89A-Fa-f][0-9A-Fa-f])*)(:[0-9]*)?') AS bad"""
        ],
        [
            f"""CASE WHEN NOT contains(s, '://') AND NOT starts_with(s, '//') THEN NULL
              WHEN regexp_matches(s, '[\\x00-\\x1f\\x7f]') OR bad THEN NULL
              ELSE CASE WHEN scheme = '' THEN 'https' ELSE lower(scheme) END || ':'
                || CASE WHEN (has_host AND (host_ <> '' OR path_ <> '' OR usr <> '')) OR (scheme = '' AND path_ <> '')
                        THEN '//' ELSE '' END
                || usr
                || CASE WHEN regexp_full_match(host_, '{plain_host}*') THEN lower(host_)
                        ELSE array_to_string(list_transform(string_split(lower(url_decode(host_)), ''),
                          lambda c: CASE WHEN regexp_full_match(c, '{plain_host}') THEN c ELSE url_encode(c) END), '') END
                || CASE WHEN rootless AND scheme <> '' THEN path_ ELSE {_encoded('path_', _PATH_CHARS, keep_path)} END
                || query
                || CASE WHEN frag = '' THEN '' ELSE '#' || {_encoded('frag', _PATH_CHARS + '?', keep_fragment)} END
              END AS n"""
        ],
    ]
    sql = source
    for stage in stages:
        sql = f"SELECT *, {', '.join(stage)} FROM ({sql})"
    helpers = "s, a, body, frag, scheme, rest, hier, has_host, query, auth, usr, path_, host_, rootless, bad"
    return f"\n{name} AS (SELECT * EXCLUDE ({helpers}) FROM ({sql}))"


def sanitized(raw: str) -> str:
    bare = f"replace(replace({raw}, 'http://', ''), 'https://', '')"
    return f"substr(regexp_replace(translate({bare}, '/?&=# :', '_______'), '[^A-Za-z0-9_.\\-]', '', 'g'), 1, 100)"


def id_of(url: str, canonical: str) -> str:
    return sanitized(f"CASE WHEN trim({canonical}, {_WS}) <> '' THEN {canonical} ELSE {url} END")


NORM_URLS = ",".join(
    [
        normalized("norm_url", "SELECT key, url AS u FROM recs"),
        normalized("norm_canonical", "SELECT key, canonical_url AS u FROM recs"),
    ]
)


def links(name: str, column: str) -> str:
    return normalized(
        f"{name}_rows",
        f"SELECT key, unnest({column}) AS u, generate_subscripts({column}, 1) AS pos FROM recs",
    ) + f""",
{name} AS (SELECT key, list(n ORDER BY pos) AS links FROM {name}_rows WHERE n IS NOT NULL GROUP BY key)"""


# --- spam ----------------------------------------------------------------------------------------------------------

SPAM = f"""
dictionary(phrase, weight) AS (VALUES {', '.join(f'({lit(p)}, {w})' for p, w in DICTIONARY.items())}),
low AS (SELECT key, text, lower(text) AS low FROM recs),
matches AS (SELECT key, phrase, weight FROM low JOIN dictionary ON contains(low, phrase)),
spam AS (
  SELECT key, text, raw, CAST(CASE WHEN length(text) > 5000 THEN raw * 5000 // length(text) ELSE raw END AS INTEGER) AS spam
  FROM (SELECT low.key, low.text, CAST(coalesce(r, 0) AS BIGINT) AS raw FROM low
        LEFT JOIN (SELECT key, sum(weight) AS r FROM matches GROUP BY key) t ON low.key = t.key))"""

# --- language ------------------------------------------------------------------------------------------------------

PROFILE = """
chars AS (
  SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS pos
  FROM (SELECT doc_id, string_split(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g'), '') AS cs FROM documents)),
grams AS (
  SELECT doc_id, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS gram FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
counts AS (
  SELECT lower(lang) AS lang, gram, count(*) AS n FROM grams JOIN documents USING (doc_id)
  WHERE gram IS NOT NULL AND lang IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total, (SELECT count(DISTINCT gram) FROM counts) AS v FROM counts GROUP BY lang),
profile AS (
  SELECT lang, gram, ln((n + 0.5) / (total + 0.5 * v)) AS logp FROM counts JOIN totals USING (lang)
  UNION ALL SELECT lang, '', ln(0.5 / (total + 0.5 * v)) FROM totals)"""

DETECT = """
by_page AS (
  SELECT doc_id, gram, count(*) AS n FROM grams JOIN documents USING (doc_id)
  WHERE gram IS NOT NULL AND strlen(text) >= 20 GROUP BY ALL),
averages AS (
  SELECT doc_id, t.lang, sum(n * coalesce(p.logp, unseen.logp)) / sum(n) AS a
  FROM by_page CROSS JOIN totals t
  LEFT JOIN profile p ON p.lang = t.lang AND p.gram = by_page.gram
  JOIN profile unseen ON unseen.lang = t.lang AND unseen.gram = ''
  WHERE by_page.doc_id IN (SELECT doc_id FROM by_page WHERE gram IN (SELECT gram FROM profile))
  GROUP BY ALL),
scores AS (
  SELECT CAST(doc_id AS VARCHAR) AS key, arg_max(lang, a) AS detected,
    sum(CASE WHEN lang = 'en' THEN exp(a) ELSE 0 END) / sum(exp(a)) AS en_conf
  FROM averages GROUP BY doc_id),
gated AS (
  SELECT recs.key, detected, en_conf,
    CASE WHEN strlen(text) < 20 THEN 'unknown' ELSE coalesce(detected, 'unknown') END AS lang,
    lang NOT IN ('unknown', 'en') AND NOT coalesce(en_conf, 0) > 0.33 AS rejected
  FROM recs LEFT JOIN scores ON recs.key = scores.key)"""

# --- enrichment ----------------------------------------------------------------------------------------------------

LABEL_ENRICHMENT = """
enrichment AS (
  SELECT CAST(doc_id AS VARCHAR) AS key,
    CASE WHEN quality = 1 THEN ['QUALITY: ' || quality] ELSE [] END AS entities,
    CASE WHEN quality = 1 THEN ['a' || quality, 'b' || quality, 'c' || quality, 'd' || quality] ELSE ['low'] END AS keyphrases
  FROM labels)"""

# Entities, written for this engine: an item with the rest of its word, then labels for whole items.
_MONTHS = "(January|February|March|April|May|June|July|August|September|October|November|December)"
_LETTERS = "[\\p{L}\\p{N}_]"
_LABELS = (
    ("MONEY", "[$€£] ?[0-9]+(,[0-9]+)*(\\.[0-9]+)?"),
    ("PERCENT", "[0-9]+(\\.[0-9]+)? ?%"),
    ("DATE", f"[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]|[0-9][0-9]? {_MONTHS} [0-9][0-9][0-9][0-9]|{_MONTHS} [0-9][0-9]?, [0-9][0-9][0-9][0-9]"),
    ("TIME", "[0-9][0-9]?:[0-9][0-9](:[0-9][0-9])?"),
    ("ORG", "[A-Za-z0-9][A-Za-z0-9-]*(\\.[A-Za-z0-9-]+)*\\.(com|org|net)"),
    ("CARDINAL", "[0-9]+([.,][0-9]+)*"),
)
_ITEMS = "|".join(
    f"({p}){_LETTERS}*"
    for p in [
        *(p for name, p in _LABELS if name in ("MONEY", "PERCENT", "DATE", "TIME")),
        f"[0-9]+([.,][0-9]+)*{_LETTERS}*(\\.[A-Za-z][A-Za-z0-9-]*)*", "[A-Za-z0-9][A-Za-z0-9-]*(\\.[A-Za-z0-9-]+)*", _LETTERS,
    ]
)
_LABEL = " ".join(f"WHEN regexp_full_match(item, {lit(p)}) THEN '{name}'" for name, p in _LABELS)


def entities(records: str) -> str:
    """Candidates are linked to the next that begins behind them; the chain from the first one is the document's list."""
    return f"""
items AS (
  SELECT key, unnest(its) AS item, generate_subscripts(its, 1) AS ord
  FROM (SELECT key, regexp_extract_all(text, {lit(_ITEMS)}) AS its FROM {records})),
placed AS (
  SELECT key, item, len(regexp_extract_all(item, '{_LETTERS}+')) AS n,
    sum(len(regexp_extract_all(item, '{_LETTERS}+'))) OVER (PARTITION BY key ORDER BY ord) AS upto FROM items),
name_words AS (
  SELECT key, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos, ws
  FROM (SELECT key, regexp_extract_all(text, '{_LETTERS}+') AS ws FROM {records})),
gazetteer AS (
  SELECT DISTINCT regexp_extract_all(name, '{_LETTERS}+') AS ns
  FROM (SELECT lower(regexp_extract(url, '([a-z0-9\\-]+)\\.example\\.', 1)) AS name FROM pages) WHERE name <> ''),
mentions AS (
  SELECT key, pos, len(ns) AS n, 'ORG: ' || array_to_string(ws[pos + 1 : pos + len(ns)], ' ') AS entity
  FROM name_words JOIN gazetteer ON lower(word) = ns[1] WHERE lower(array_to_string(ws[pos + 1 : pos + len(ns)], ' ')) = array_to_string(ns, ' ')),
choices AS (
  SELECT key, pos, n, 0 AS kind, entity FROM mentions
  UNION ALL
  SELECT key, (upto - n)::BIGINT, n, 1, label || ': ' || item
  FROM (SELECT *, CASE {_LABEL} END AS label FROM placed) WHERE label IS NOT NULL),
heads AS (
  SELECT key, pos, n, entity, row_number() OVER (PARTITION BY key ORDER BY pos) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY key, pos ORDER BY n DESC, kind) AS r FROM choices) WHERE r = 1),
head_links AS (SELECT a.*, b.pos AS next FROM heads a ASOF LEFT JOIN heads b ON a.key = b.key AND a.pos + a.n <= b.pos),
chain AS (
  SELECT key, pos, entity, next FROM head_links WHERE rank = 1
  UNION ALL
  SELECT l.key, l.pos, l.entity, l.next FROM chain c JOIN head_links l ON l.key = c.key AND l.pos = c.next),
listed AS (SELECT key, list(entity ORDER BY pos) AS found FROM chain GROUP BY key),
entities AS (SELECT r.key, coalesce(found, []) AS entities FROM {records} r LEFT JOIN listed USING (key))"""


def relevance(records: str) -> str:
    stops = ", ".join(lit(w) for w in STOP_WORDS)
    return f"""
all_words AS (
  SELECT key, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT key, regexp_extract_all(lower(text), {lit(TOKEN)}) AS ws FROM {records})),
kept_words AS (SELECT * FROM all_words WHERE word NOT IN ({stops})),
idfs AS (
  SELECT word, ln((1 + (SELECT count(*) FROM {records})) / (1 + count(DISTINCT key))) + 1 AS idf FROM kept_words GROUP BY word),
weighted AS (
  SELECT key, pos, word, idf * idf AS g, idf * idf * count(*) OVER (PARTITION BY key, word) AS d
  FROM kept_words JOIN idfs USING (word)),
led AS (
  SELECT key, word AS w1, g AS g1, d AS d1,
    lead(word, 1) OVER w AS w2, lead(g, 1) OVER w AS g2, lead(d, 1) OVER w AS d2,
    lead(word, 2) OVER w AS w3, lead(g, 2) OVER w AS g3, lead(d, 2) OVER w AS d3,
    sqrt(sum(d) OVER (PARTITION BY key)) AS page_norm
  FROM weighted WINDOW w AS (PARTITION BY key ORDER BY pos)),
candidates AS (
  SELECT DISTINCT key, 1 AS n, w1 AS phrase, w1, '' AS w2, '' AS w3, g1, 0.0::DOUBLE AS g2, 0.0::DOUBLE AS g3, sqrt(g1) AS norm,
    round(d1 / (sqrt(g1) * page_norm), 9) AS rel FROM led
  UNION ALL
  SELECT DISTINCT key, 2, w1 || ' ' || w2, w1, w2, '', g1, g2, 0.0,
    sqrt(g1 + g2 + CASE WHEN w1 = w2 THEN 2 * g1 ELSE 0 END) AS norm, round((d1 + d2) / (norm * page_norm), 9)
  FROM led WHERE w2 IS NOT NULL
  UNION ALL
  SELECT DISTINCT key, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, g1, g2, g3,
    sqrt(g1 + g2 + g3 + CASE WHEN w1 = w2 THEN 2 * g1 ELSE 0 END + CASE WHEN w1 = w3 THEN 2 * g1 ELSE 0 END
      + CASE WHEN w2 = w3 THEN 2 * g2 ELSE 0 END) AS norm, round((d1 + d2 + d3) / (norm * page_norm), 9)
  FROM led WHERE w3 IS NOT NULL)"""


_SHARED = " + ".join(
    f"CASE WHEN w{a} <> '' AND w{a} = b{b} THEN sqrt(g{a}) * sqrt(h{b}) ELSE 0 END" for a in (1, 2, 3) for b in (1, 2, 3)
)


def keyphrases(records: str) -> str:
    """Maximal marginal relevance by recursion over all candidates: every step takes one phrase per page."""
    best = ", ".join(
        f"first_value({column}) OVER w AS {name}"
        for column, name in [("phrase", "best"), ("norm", "best_norm"), ("taken", "best_taken")]
        + [(f"w{i}", f"b{i}") for i in (1, 2, 3)] + [(f"g{i}", f"h{i}") for i in (1, 2, 3)]
    )
    return relevance(records) + f""",
mmr AS (
  SELECT *, 0.0::DOUBLE AS red, 0 AS taken, 0 AS step FROM candidates
  UNION ALL
  SELECT key, n, phrase, w1, w2, w3, g1, g2, g3, norm, rel,
    greatest(red, ({_SHARED}) / (norm * best_norm)),
    CASE WHEN taken = 0 AND phrase = best THEN step + 1 ELSE taken END, step + 1
  FROM (SELECT *, {best} FROM mmr WHERE step < 10
        WINDOW w AS (PARTITION BY key ORDER BY taken > 0, round(0.5 * rel - 0.5 * round(red, 9), 9) DESC, rel DESC, phrase))),
keyphrases AS (
  SELECT p.key, coalesce(phrases, []) AS keyphrases FROM {records} p LEFT JOIN
    (SELECT key, list(phrase ORDER BY rel DESC, phrase) AS phrases FROM mmr WHERE step = 10 AND taken > 0 GROUP BY key) k
    ON p.key = k.key)"""


# --- the pipeline --------------------------------------------------------------------------------------------------

STORE = f"""
store AS (SELECT DISTINCT {signature('text')} AS sig FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""
NO_STORE = """
store AS (SELECT '' AS sig WHERE false)"""

DECISIONS = f"""
signed AS (
  SELECT recs.*, n AS norm_url, {signature('text')} AS sig FROM recs JOIN norm_url ON recs.key = norm_url.key),
firsts AS (
  SELECT arg_min(key, i) AS key FROM signed WHERE norm_url IS NOT NULL AND sig NOT IN (SELECT sig FROM store) GROUP BY sig),
decisions AS (
  SELECT signed.*, f.key IS NOT NULL AS claims, CASE WHEN norm_url IS NULL THEN 'unknown' ELSE gated.lang END AS lang, gated.rejected, spam.spam, strlen(signed.text) AS n_bytes,
    CASE WHEN norm_url IS NULL THEN 'invalid_url' WHEN NOT claims THEN 'duplicate' WHEN gated.rejected THEN 'non_english'
         WHEN signed.text <> '' AND spam >= {OPTIONS.spam_threshold} THEN 'high_spam' ELSE 'indexed' END AS outcome
  FROM signed LEFT JOIN firsts f ON signed.key = f.key JOIN gated ON signed.key = gated.key JOIN spam ON signed.key = spam.key)"""


def quality(text: str, title: str, meta: str, n_entities: str, n_keywords: str, internal: str, external: str, lang: str) -> str:
    return f"""CAST(CASE WHEN strlen({text}) > 100 THEN 10 ELSE 0 END
      + CASE WHEN strlen({title}) > 5 AND strlen({title}) < 150 THEN 10 ELSE 0 END
      + CASE WHEN strlen({meta}) > 50 THEN 5 ELSE 0 END
      + CASE WHEN coalesce({n_entities}, 0) >= 1 THEN 10 ELSE 0 END + CASE WHEN coalesce({n_keywords}, 0) > 3 THEN 10 ELSE 0 END
      + CASE WHEN {internal} IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN {external} IS NOT NULL THEN 5 ELSE 0 END
      + CASE WHEN {lang} = 'en' THEN 10 ELSE 0 END + CASE WHEN is_secure THEN 25 ELSE 0 END
      + CASE WHEN {load_ms('load_time')} < 1000 THEN 10 WHEN {load_ms('load_time')} < 2000 THEN 5
             WHEN {load_ms('load_time')} < 3000 THEN 2 ELSE 0 END AS INTEGER)"""


DOCUMENTS = f"""
docs AS (
  SELECT d.key, d.i,
    CASE WHEN text = '' THEN 'empty_text' WHEN e.key IS NULL THEN 'nlp_failed' ELSE 'full' END AS shape,
    shape = 'full' AS ok,
    CASE WHEN ok THEN d.url ELSE d.norm_url END AS url,
    CASE WHEN ok THEN coalesce(c.n, d.canonical_url) ELSE '' END AS canonical_url,
    CASE WHEN ok THEN d.title ELSE '' END AS title,
    CASE WHEN ok THEN d.meta_description ELSE '' END AS meta_description,
    CASE WHEN ok THEN text ELSE trim(regexp_replace(text, {_WS_CLASS}, ' ', 'g'), ' ') END AS visible_text,
    CASE WHEN ok AND len(e.entities) > 0 THEN e.entities END AS entities,
    CASE WHEN ok THEN e.keyphrases END AS keywords,
    CASE WHEN ok THEN d.lang ELSE '' END AS language,
    CASE WHEN ok THEN li.links END AS internal_links,
    CASE WHEN ok THEN le.links END AS external_links,
    CASE WHEN ok THEN d.date_published END AS date_published,
    CASE WHEN ok THEN ['https://Social.example.com/a'] END AS social_links,
    CASE WHEN ok THEN {load_ms('d.load_time')} ELSE 0 END AS load_time_,
    CASE WHEN ok THEN d.is_secure ELSE false END AS is_secure_,
    CASE WHEN ok THEN greatest({quality('text', 'd.title', 'd.meta_description', 'len(e.entities)', 'len(e.keyphrases)', 'li.links', 'le.links', 'd.lang')}
      - 2 * d.spam, 0) ELSE 0 END AS quality_score,
    d.spam AS spam_score
  FROM (SELECT * FROM decisions WHERE outcome = 'indexed') d
  LEFT JOIN enrichment e ON d.key = e.key LEFT JOIN norm_canonical c ON d.key = c.key
  LEFT JOIN internal li ON d.key = li.key LEFT JOIN external le ON d.key = le.key),
identified AS (SELECT {id_of('url', 'canonical_url')} AS _id, * FROM docs)"""

LATEST = """
latest AS (SELECT * FROM identified QUALIFY row_number() OVER (PARTITION BY _id ORDER BY i DESC) = 1)"""

_JOINED = "array_to_string({0}, ' | ') AS {0}"


def query(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes) + "\n" + select


_TO_DECISIONS = [PAGES, NORM_URLS, SPAM, PROFILE, DETECT, STORE, DECISIONS]
_TO_DOCUMENTS = [*_TO_DECISIONS, LABEL_ENRICHMENT, links("internal", "internal_links"), links("external", "external_links"), DOCUMENTS]


UNKEYED = f"""
, keyed AS (SELECT *, i % 11 = 0 AS unkeyed FROM signed)
, kept AS (SELECT arg_min(key, i) AS key FROM keyed WHERE norm_url IS NOT NULL AND NOT unkeyed GROUP BY sig)
, decided AS (
  SELECT k.key, CASE WHEN norm_url IS NULL OR unkeyed THEN 'unknown' ELSE gated.lang END AS lang, strlen(k.text) AS n_bytes,
    CASE WHEN norm_url IS NULL THEN 'invalid_url' WHEN unkeyed THEN 'unkeyed' WHEN kept.key IS NULL THEN 'duplicate'
         WHEN gated.rejected THEN 'non_english' WHEN k.text <> '' AND spam >= {OPTIONS.spam_threshold} THEN 'high_spam' ELSE 'indexed' END AS outcome
  FROM keyed k LEFT JOIN kept ON kept.key = k.key JOIN gated ON gated.key = k.key JOIN spam ON spam.key = k.key)
SELECT count(CASE WHEN outcome = 'indexed' THEN 1 END) AS pages_processed, count(CASE WHEN outcome = 'invalid_url' THEN 1 END) AS invalid_urls,
  count(CASE WHEN outcome = 'unkeyed' THEN 1 END) AS unkeyed, count(CASE WHEN outcome = 'duplicate' THEN 1 END) AS duplicates,
  count(CASE WHEN outcome = 'non_english' THEN 1 END) AS non_english, count(CASE WHEN outcome = 'high_spam' THEN 1 END) AS high_spam,
  count(CASE WHEN outcome NOT IN ('invalid_url', 'unkeyed', 'duplicate') AND lang = 'unknown' AND n_bytes >= 20 THEN 1 END) AS detection_failures
FROM decided"""


def all_oracles() -> dict[str, str]:
    threshold = OPTIONS.spam_threshold
    bounds = [*SPAM_BUCKETS, None]
    found = {
        "clean_text": query(
            [PAGES, HTML_PAGES],
            f"""SELECT key, trim(regexp_replace(text, {_WS_CLASS}, ' ', 'g'), ' ') AS cleaned, strlen(text) AS n_bytes
            FROM (SELECT key, text FROM recs UNION ALL SELECT 'p' || key, text FROM html_pages)""",
        ),
        "content_signature": query([PAGES], f"SELECT key, {signature('text')} AS sig FROM recs"),
        "normalize_url": query(
            [
                PAGES, HTML_PAGES,
                "raw AS (SELECT key, url, canonical_url FROM recs UNION ALL SELECT 'p' || key, url, '' FROM html_pages)",
                normalized("a_url", "SELECT key, url AS u FROM raw"),
                normalized("a_canonical", "SELECT key, canonical_url AS u FROM raw"),
            ],
            "SELECT x.key, x.n AS norm_url, coalesce(y.n, y.u) AS canonical FROM a_url x JOIN a_canonical y ON x.key = y.key",
        ),
        "normalize_links": query(
            [
                HTML_PAGES,
                """raw AS (SELECT key, CASE WHEN i % 2 = 0 THEN flatten(list_transform(hrefs,
                  lambda h: [h, 'https://' || host || h, '//' || host || h])) ELSE hrefs END AS ls FROM html_pages)""",
                normalized("rows_", "SELECT key, unnest(ls) AS u, generate_subscripts(ls, 1) AS pos FROM raw"),
            ],
            """SELECT html_pages.key, array_to_string(links, ' | ') AS links, coalesce(len(links), 0) AS n_links FROM html_pages
            LEFT JOIN (SELECT key, list(n ORDER BY pos) AS links FROM rows_ WHERE n IS NOT NULL GROUP BY key) l
            ON html_pages.key = l.key""",
        ),
        "doc_id": query(
            [PAGES, NORM_URLS],
            f"""SELECT recs.key, {id_of('url', 'canonical_url')} AS raw_id,
              {id_of('coalesce(a.n, url)', 'coalesce(b.n, canonical_url)')} AS id, {load_ms('load_time')} AS load_ms
            FROM recs JOIN norm_url a ON recs.key = a.key JOIN norm_canonical b ON recs.key = b.key""",
        ),
        "dedup_first_wins": query(
            [PAGES],
            f"""SELECT key, {signature('text')} AS sig, row_number() OVER (PARTITION BY sig ORDER BY i) > 1 AS is_duplicate
            FROM recs""",
        ),
        "dedup_against_store": query(
            [PAGES, STORE],
            f"""SELECT arg_min(key, i) AS key, {signature('text')} AS sig FROM recs
            WHERE {signature('text')} NOT IN (SELECT sig FROM store) GROUP BY sig""",
        ),
        "dedup_seen_before": query(
            [PAGES, STORE],
            f"""SELECT arg_min(key, i) AS key, {signature('text')} AS sig FROM recs
            WHERE {signature('text')} IN (SELECT sig FROM store) GROUP BY sig""",
        ),
        "spam_score": query([PAGES, SPAM], "SELECT key, raw, spam AS spam_score FROM spam"),
        "spam_score_join": query([PAGES, SPAM], "SELECT key, spam AS spam_score FROM spam"),
        "spam_phrases": query([PAGES, SPAM], "SELECT key, phrase FROM matches"),
        "dictionary_matches": query([PAGES, SPAM], "SELECT phrase, weight, count(*) AS pages FROM matches GROUP BY ALL"),
        "spam_gate": query(
            [PAGES, SPAM], f"SELECT key, spam AS spam_score, text <> '' AND spam >= {threshold} AS is_high_spam FROM spam"
        ),
        "spam_histogram": query(
            [
                PAGES, SPAM,
                f"passed AS (SELECT spam FROM spam WHERE NOT (text <> '' AND spam >= {threshold}))",
                "bounds(bound, b) AS (VALUES "
                + ", ".join("('+Inf', 1e9)" if b is None else f"('{b}', {b})" for b in bounds)
                + ")",
            ],
            """SELECT bound, count(CASE WHEN spam <= b THEN 1 END) AS pages, count(*) AS n, sum(spam)::BIGINT AS score_sum
            FROM bounds CROSS JOIN passed GROUP BY bound""",
        ),
        "language_profile": query([PROFILE], "SELECT lang, gram, round(logp, 6) AS logp FROM profile"),
        "language_detect": query(
            [PAGES, PROFILE, DETECT], "SELECT key, detected, round(en_conf, 6) AS en_conf FROM gated"
        ),
        "language_gate": query([PAGES, PROFILE, DETECT], "SELECT key, lang, rejected FROM gated"),
        "entities": query(
            [PAGES, entities("recs")],
            "SELECT key, CASE WHEN len(entities) > 0 THEN array_to_string(entities, ' | ') END AS entities FROM entities",
            recursive=True,
        ),
        "keyphrase_relevance": query(
            [PAGES, relevance("recs")],
            """SELECT key, row_number() OVER (PARTITION BY key ORDER BY rel DESC, phrase) - 1 AS rank, phrase
            FROM candidates QUALIFY rank < 10""",
        ),
        "word_frequencies": query(
            [PAGES, relevance("recs")],
            """SELECT word, count(DISTINCT key) AS df FROM kept_words GROUP BY word
            UNION ALL SELECT '', count(*) FROM recs""",
        ),
        "keyphrases": query(
            [PAGES, keyphrases("recs")],
            "SELECT key, array_to_string(keyphrases, ' | ') AS keyphrases FROM keyphrases",
            recursive=True,
        ),
        "enrichment_join": query(
            [PAGES, LABEL_ENRICHMENT],
            """SELECT recs.key, CASE WHEN text = '' THEN 'empty_text' WHEN e.key IS NULL THEN 'nlp_failed' ELSE 'full' END AS shape,
              CASE WHEN len(entities) > 0 THEN array_to_string(entities, ' | ') END AS entities,
              array_to_string(keyphrases, ' | ') AS keyphrases FROM recs LEFT JOIN enrichment e ON recs.key = e.key""",
        ),
        "batch_results": query(
            [
                PAGES, LABEL_ENRICHMENT,
                """whole AS (SELECT i // 2 AS batch FROM recs LEFT JOIN enrichment e ON recs.key = e.key
                  GROUP BY batch HAVING count(e.key) = count(*))""",
            ],
            """SELECT e.key, CASE WHEN len(entities) > 0 THEN array_to_string(entities, ' | ') END AS entities,
              array_to_string(keyphrases, ' | ') AS keyphrases
            FROM enrichment e WHERE CAST(e.key AS BIGINT) // 2 IN (SELECT batch FROM whole)""",
        ),
        "enrichment_counters": query(
            [PAGES, LABEL_ENRICHMENT],
            """SELECT count(CASE WHEN text <> '' THEN 1 END) AS nlp_requests,
              count(CASE WHEN text <> '' AND e.key IS NULL THEN 1 END) AS nlp_errors
            FROM recs LEFT JOIN enrichment e ON recs.key = e.key""",
        ),
        "quality_score": query(
            [PAGES, SPAM, LABEL_ENRICHMENT, links("internal", "internal_links"), links("external", "external_links")],
            f"""SELECT p.key, {quality('p.text', 'title', 'meta_description', 'len(entities)', 'len(keyphrases)', 'li.links', 'le.links', 'language')} AS quality,
              CAST(greatest(quality - 2 * spam, 0) AS INTEGER) AS penalized
            FROM recs p JOIN spam ON p.key = spam.key LEFT JOIN enrichment e ON p.key = e.key
            LEFT JOIN internal li ON p.key = li.key LEFT JOIN external le ON p.key = le.key""",
        ),
        "decisions": query(_TO_DECISIONS, "SELECT key, outcome, claims, lang, spam, norm_url FROM decisions"),
        "rejected": query(
            _TO_DECISIONS,
            """SELECT key, url, outcome, CASE WHEN outcome IN ('non_english', 'high_spam') THEN lang END AS detected_language,
              CASE WHEN outcome = 'high_spam' THEN spam END AS spam_score FROM decisions WHERE outcome <> 'indexed'""",
        ),
        "new_signatures": query(_TO_DECISIONS, "SELECT sig, key FROM decisions WHERE claims"),
        "outcome_counts": query(_TO_DECISIONS, "SELECT outcome, count(*) AS pages FROM decisions GROUP BY outcome"),
        "run_counters": query(
            _TO_DECISIONS,
            """SELECT 0 AS unkeyed, count(CASE WHEN outcome = 'indexed' THEN 1 END) AS pages_processed,
              count(CASE WHEN outcome = 'invalid_url' THEN 1 END) AS invalid_urls,
              count(CASE WHEN outcome = 'duplicate' THEN 1 END) AS duplicates,
              count(CASE WHEN outcome = 'non_english' THEN 1 END) AS non_english,
              count(CASE WHEN outcome = 'high_spam' THEN 1 END) AS high_spam,
              count(CASE WHEN outcome NOT IN ('invalid_url', 'duplicate') AND lang = 'unknown' AND n_bytes >= 20 THEN 1 END)
                AS detection_failures FROM decisions""",
        ),
        "documents": query(
            _TO_DOCUMENTS,
            f"""SELECT key, _id, shape, url, canonical_url, title, meta_description, visible_text, {_JOINED.format('entities')},
              {_JOINED.format('keywords')}, language, {_JOINED.format('internal_links')}, {_JOINED.format('external_links')},
              ' | ' AS structured_data, ' |  | ' AS open_graph, strftime(date_published, '%Y-%m-%d %H:%M:%S') AS date_published,
              NULL::VARCHAR AS date_modified, NULL::VARCHAR AS categories, NULL::VARCHAR AS tags,
              {_JOINED.format('social_links')}, load_time_ AS load_time, is_secure_ AS is_secure, quality_score, spam_score,
              0 AS inbound_link_count, CASE WHEN ok THEN '{CRAWLED_AT}' END AS last_crawled FROM identified""",
        ),
        "upsert_latest": query(
            [*_TO_DOCUMENTS, LATEST], "SELECT _id, key, url, title, quality_score, spam_score FROM latest"
        ),
        "id_collisions": query(
            _TO_DOCUMENTS, "SELECT _id, count(*) AS documents FROM identified GROUP BY _id HAVING count(*) > 1"
        ),
        "bulk_ndjson": query(
            _TO_DOCUMENTS,
            f"""SELECT '{{"index":{{"_index":"{OPTIONS.index_name}","_id":"' || _id || '"}}}}' || chr(10) || to_json(struct_pack(
              url := url, canonical_url := canonical_url, title := title, meta_description := meta_description,
              visible_text := visible_text, entities := entities, keywords := keywords, language := language,
              internal_links := internal_links, external_links := external_links,
              structured_data := {{'@context': '', '@type': ''}},
              open_graph := {{'og:title': '', 'og:description': '', 'og:image': ''}},
              date_published := strftime(date_published, '%Y-%m-%dT%H:%M:%S.000Z'), date_modified := NULL::VARCHAR,
              categories := NULL::VARCHAR[], tags := NULL::VARCHAR[], social_links := social_links, load_time := load_time_,
              is_secure := is_secure_, quality_score := quality_score, spam_score := spam_score, inbound_link_count := 0,
              last_crawled := CASE WHEN ok THEN '{CRAWLED_AT.replace(' ', 'T')}.000Z' END)) AS value FROM identified""",
        ),
    }
    accepted = "accepted AS (SELECT key, text FROM decisions WHERE outcome = 'indexed')"
    derived = """
enrichment AS (
  SELECT entities.key, entities, keyphrases FROM entities JOIN keyphrases ON entities.key = keyphrases.key)"""
    found["curate_derived"] = query(
        [
            *[NO_STORE if cte is STORE else cte for cte in _TO_DECISIONS], accepted, entities("accepted"),
            keyphrases("accepted"), derived, links("internal", "internal_links"), links("external", "external_links"), DOCUMENTS,
        ],
        f"""SELECT key, _id, shape, url, title, language, {_JOINED.format('entities')}, {_JOINED.format('keywords')},
          {_JOINED.format('internal_links')}, {_JOINED.format('external_links')}, quality_score, spam_score FROM identified""",
        recursive=True,
    )
    empty_store = [NO_STORE if cte is STORE else cte for cte in _TO_DOCUMENTS]
    found["stream_upsert"] = query(
        [*empty_store, LATEST], "SELECT _id, key, url, title, quality_score, spam_score FROM latest"
    )
    found["stream_sink_counters"] = query(
        empty_store,
        """SELECT count(*) AS documents_indexed, count(DISTINCT _id) AS distinct_ids FROM identified
        GROUP BY least(CAST(key AS BIGINT) * 3 // ((SELECT max(i) FROM recs) + 1), 2)""",
    )
    found["stream_first_seen"] = query(
        [PAGES], f"SELECT {signature('text')} AS sig, arg_min(key, i) AS key FROM recs WHERE i % 50 <> 0 GROUP BY sig"
    )
    found["run_counters_unkeyed"] = query(
        [*[NO_STORE if cte is STORE else cte for cte in _TO_DECISIONS]], UNKEYED
    )
    found["stream_enrichment"] = query(
        [PAGES],
        """SELECT key, CASE WHEN text = '' THEN 'empty_text' WHEN l.doc_id IS NOT NULL AND i % 16 <= 10 THEN 'full' ELSE 'nlp_failed' END AS shape,
          CASE WHEN text <> '' AND l.doc_id IS NOT NULL AND i % 16 <= 10 THEN CASE WHEN quality = 1 THEN 4 ELSE 1 END END AS n_keyphrases
        FROM recs LEFT JOIN labels l ON l.doc_id = i""",
    )
    stops = ", ".join(map(lit, STOP_WORDS))
    found["blank_texts"] = query(
        [PAGES],
        f"""SELECT key, CASE WHEN i % 4 IN (0, 2) OR text = '' THEN 'empty_text' ELSE 'full' END AS shape,
          CASE WHEN i % 4 <> 3 THEN 0 END AS n_entities,
          i % 4 = 3 AND len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({stops}))) > 0
            AS has_keyphrases FROM recs""",
    )
    found["pages_from_files"] = query(
        [PAGES], "SELECT url, canonical_url, title, load_time, is_secure, strlen(text) AS n_bytes, false AS undecodable FROM recs "
        "UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true FROM labels"
    )
    weights = ", ".join(f"({lit(p)}, {w})" for p, w in EXPLICIT_WEIGHTS.items())
    found["dictionary_from_files"] = f"""
    WITH given(phrase, weight) AS (VALUES {weights}), listed AS (
      SELECT DISTINCT phrase FROM (SELECT regexp_extract(text, '^[^.\\n]*', 0) AS phrase FROM documents
        UNION ALL SELECT lower(regexp_extract(text, '^[^.\\n]*', 0)) FROM documents UNION ALL SELECT phrase FROM given) WHERE phrase <> '')
    SELECT lower(l.phrase) AS phrase, max(coalesce(weight, 1))::INTEGER AS weight FROM listed l LEFT JOIN given USING (phrase) GROUP BY 1"""
    found["profile_by_batches"] = found["language_profile"]
    found["frequencies_by_batches"] = found["word_frequencies"]
    found["entities_by_anchors"] = found["entities"]
    found["language_detect_rest"] = found["language_detect"]
    found["stream_counters"] = query(
        empty_store,
        """SELECT least(i * 3 // ((SELECT max(i) FROM recs) + 1), 2) AS batch_id,
          count(CASE WHEN outcome = 'indexed' THEN 1 END) AS pages_processed, count(CASE WHEN outcome = 'invalid_url' THEN 1 END) AS invalid_urls,
          count(CASE WHEN outcome = 'duplicate' THEN 1 END) AS duplicates, count(CASE WHEN claims THEN 1 END) AS claims,
          count(CASE WHEN outcome = 'indexed' AND text <> '' THEN 1 END) AS nlp_requests,
          count(CASE WHEN outcome = 'indexed' AND text <> '' AND key NOT IN (SELECT key FROM enrichment) THEN 1 END) AS nlp_errors
        FROM decisions GROUP BY 1""",
    )
    return found
