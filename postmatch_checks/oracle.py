"""SQL for the comparison engine, one text per registered query.

The texts are put together from named steps; each query takes only the steps it
needs. Lists that both engines need (vocabularies, stop words) come from the
options, so the SQL states rules, not copies of them.
"""

from __future__ import annotations

import re
from pathlib import Path
from zipfile import ZipFile

import pyspark
from pyspark.ml.feature import StopWordsRemover

from postmatch import fixed
from postmatch.operators.semantic import HashingEncoder
from postmatch.sinks import report
from postmatch.sources import html, search
from postmatch_checks import tables

SPACES = (
    r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
NO_TEXT = "no text"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACES}', ' ', 'g'))"


def _normal(x: str) -> str:
    return _squeeze(f"lower({x})")


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACES}', ''), '{SPACES}$', '')"


def _bounded(x: str) -> str:
    return (
        f"round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, coalesce(CASE WHEN isnan({x}) "
        f"THEN 0.0::DOUBLE ELSE {x} END, 0.0::DOUBLE))), 2)"
    )


def _pct(part: str, whole: str) -> str:
    value = f"(({part})::DOUBLE / nullif(({whole})::DOUBLE, 0) * 100)"
    return f"round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, coalesce({value}, 0.0::DOUBLE))), 2)"


def _joined(x: str) -> str:
    return f"array_to_string({x}, ', ')"


def _escape(x: str) -> str:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {_quoted(plain)}, {_quoted(safe)})"
    return x


def _decoded(x: str) -> str:
    for reference, plain in html.NAMED_ENTITIES.items():
        x = f"replace({x}, {_quoted(reference)}, {_quoted(plain)})"
    return f"replace({x}, '&amp;', '&')"


def _markup(x: str) -> str:
    unseen = r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"
    marked = f"regexp_replace({x}, '{unseen}', chr(1), 'g')"
    return _strip(_decoded(f"regexp_replace({marked}, '\\x01+', ' ', 'g')"))


def _stop_words() -> list[str]:
    """Spark's own English list. It is read from Spark's library where that is at hand,
    since asking Spark takes a session and the SQL is text alone."""
    for jar in Path(pyspark.__file__).parent.glob("jars/spark-mllib_*.jar"):
        with ZipFile(jar) as files:
            return files.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split()
    return StopWordsRemover.loadDefaultStopWords("english")


def _steps() -> dict[str, str]:
    """Named steps; a step may use those before it."""
    stop = _list(_stop_words())
    skills = _list(sorted(fixed.SKILLS))
    education = _list(sorted(fixed.EDUCATION_TERMS))
    words = f"regexp_extract_all({{}}, '{fixed.TOKEN_PATTERN}')"
    keep = f"list_filter({{}}, lambda w: length(w) > 2 AND NOT list_contains({stop}, w))"
    dims = HashingEncoder().dimensions
    modulus = "4294967296::UBIGINT"

    def mixed(x: str) -> str:
        """First half of the hash's block step, as nested list steps over 32-bit values."""
        a = f"list_transform({x}, lambda k: (k * 3432918353::UBIGINT) % {modulus})"
        b = f"list_transform({a}, lambda k: (k * 32768::UBIGINT) % {modulus} + k // 131072::UBIGINT)"
        return f"list_transform({b}, lambda k: (k * 461845907::UBIGINT) % {modulus})"

    def byte(at: str) -> str:
        return f"ascii(substr(token, ({at})::BIGINT, 1))::UBIGINT"

    block = " + ".join(f"{byte(f'4 * i + {j + 1}')} * {256 ** j}::UBIGINT" for j in range(4))
    tail = " + ".join(
        f"CASE WHEN length(token) % 4 > {j} THEN {byte(f'(length(token) // 4) * 4 + {j + 1}')} * {256 ** j}::UBIGINT ELSE 0::UBIGINT END"
        for j in range(3)
    )
    steps = {
        "posting": tables.over_views(tables.POSTINGS),
        "vocabulary": tables.over_views(tables.VOCABULARY),
        "text_with_part": tables.over_views(tables.TEXTS_WITH_PARTS),
        "part_of_profile": tables.over_views(tables.PROFILE_PARTS),
        "profile_text": (
            f"SELECT profile_id, {_strip('string_agg(coalesce(text, %s), chr(10) ORDER BY part_no)' % _quoted(''))} AS text "
            "FROM part_of_profile GROUP BY profile_id"
        ),
        "p0": f"SELECT posting_id, job_title, job_link, job_description, {_normal('job_description')} AS d, {_normal('job_title')} AS t FROM posting",
        "p": (
            f"SELECT *, {keep.format(words.format('d'))} AS toks, "
            f"list_sort(list_filter({skills}, lambda k: contains(d, k))) AS sk, "
            f"list_sort(list_filter({education}, lambda k: contains(d, k))) AS ed, "
            f"list_sort(list_distinct({keep.format(words.format('t'))})) AS tt, "
            f"list_max(list_transform(regexp_extract_all(d, '{fixed.YEARS_PATTERN}', 1), lambda y: y::DOUBLE)) AS yrs FROM p0"
        ),
        "r0": f"SELECT profile_id, {_normal('text')} AS r FROM profile_text",
        "r": (
            f"SELECT *, {keep.format(words.format('r'))} AS toks, "
            f"list_sort(list_filter({skills}, lambda k: contains(r, k))) AS sk, "
            f"list_max(list_transform(regexp_extract_all(r, '{fixed.YEARS_PATTERN}', 1), lambda y: y::DOUBLE)) AS yrs FROM r0"
        ),
        "word": "SELECT posting_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM p",
        "term": "SELECT posting_id, token, count(*) AS n, min(pos) AS first_pos FROM word GROUP BY posting_id, token",
        "boost": (
            "SELECT posting_id, unnest(sk) AS token FROM p WHERE len(toks) > 0"
        ),
        "weighed": (
            "SELECT posting_id, token, sum(n)::BIGINT AS weight, min(first_pos) AS first_pos FROM ("
            "SELECT posting_id, token, n, first_pos FROM term UNION ALL "
            "SELECT posting_id, token, 2, 2147483647 FROM boost) GROUP BY posting_id, token"
        ),
        "keyword": (
            "SELECT posting_id, token, weight, rank FROM (SELECT *, (row_number() OVER ("
            "PARTITION BY posting_id ORDER BY weight DESC, first_pos, token))::INT AS rank FROM weighed) WHERE rank <= 25"
        ),
        "pair": "SELECT p.posting_id, r.profile_id, p.d, p.t, r.r, p.sk, r.sk AS rsk, p.ed, p.tt, p.yrs, r.yrs AS ryrs FROM p, r",
        "kw": (
            f"SELECT k.posting_id, r.profile_id, {_pct('coalesce(sum(k.weight) FILTER (WHERE contains(r.r, k.token)), 0)', 'sum(k.weight)')} AS keyword_match "
            "FROM keyword k, r GROUP BY k.posting_id, r.profile_id"
        ),
        # Term hashing: the public MurmurHash3 x86 32-bit function with seed 42.
        "known": "SELECT DISTINCT token FROM (SELECT token FROM word UNION ALL SELECT unnest(toks) FROM r)",
        "hash0": (
            f"SELECT token, {mixed(f'list_transform(range(0, length(token) // 4), lambda i: {block})')} AS blocks, "
            f"{mixed(f'[{tail}]')}[1] AS rest FROM known"
        ),
        "hash1": (
            "SELECT token, xor(xor(list_reduce(list_prepend(42::UBIGINT, blocks), lambda h, k: "
            f"((((xor(h, k) * 8192::UBIGINT) % {modulus} + xor(h, k) // 524288::UBIGINT) * 5::UBIGINT) + 3864292196::UBIGINT) % {modulus}), rest), "
            "length(token)::UBIGINT) AS h FROM hash0"
        ),
        "hash2": f"SELECT token, (xor(h, h // 65536::UBIGINT) * 2246822507::UBIGINT) % {modulus} AS h FROM hash1",
        "hash3": f"SELECT token, (xor(h, h // 8192::UBIGINT) * 3266489909::UBIGINT) % {modulus} AS h FROM hash2",
        "bucket_of": f"SELECT token, (xor(h, h // 65536::UBIGINT) % {dims})::INT AS bucket FROM hash3",
        "vec": "SELECT posting_id, bucket, sum(n)::DOUBLE AS weight FROM term JOIN bucket_of USING (token) GROUP BY posting_id, bucket",
        "rvec": (
            "SELECT profile_id, bucket, count(*)::DOUBLE AS weight FROM (SELECT profile_id, unnest(toks) AS token FROM r) "
            "JOIN bucket_of USING (token) GROUP BY profile_id, bucket"
        ),
        "vnorm": "SELECT posting_id, sqrt(sum(weight * weight)) AS norm FROM vec GROUP BY posting_id",
        "rnorm": "SELECT profile_id, sqrt(sum(weight * weight)) AS norm FROM rvec GROUP BY profile_id",
        "dots": "SELECT posting_id, profile_id, sum(vec.weight * rvec.weight) AS dot FROM vec JOIN rvec USING (bucket) GROUP BY posting_id, profile_id",
        "cosines": (
            f"SELECT posting_id, profile_id, {_bounded('(dot / (rnorm.norm * vnorm.norm) * 100)')} AS semantic_match "
            "FROM dots JOIN vnorm USING (posting_id) JOIN rnorm USING (profile_id)"
        ),
        "compared": (
            "SELECT *, d <> '' AS has_text, "
            "list_sort(list_filter(sk, lambda k: list_contains(rsk, k))) AS matched, "
            "list_sort(list_filter(sk, lambda k: NOT list_contains(rsk, k))) AS missing, "
            f"{_pct('len(list_filter(tt, lambda w: contains(r, w)))', 'len(tt)')} AS title_match, "
            "CASE WHEN yrs IS NULL THEN 100.0::DOUBLE WHEN ryrs IS NULL THEN 0.0::DOUBLE WHEN ryrs >= yrs THEN 100.0::DOUBLE "
            f"ELSE {_pct('ryrs', 'yrs')} END AS experience_match, "
            f"CASE WHEN len(ed) = 0 THEN 100.0::DOUBLE ELSE {_pct('len(list_filter(ed, lambda w: contains(r, w)))', 'len(ed)')} END AS education_bonus "
            "FROM pair"
        ),
        "signal": (
            "SELECT posting_id, profile_id, has_text, "
            "CASE WHEN has_text AND r <> '' THEN coalesce(semantic_match, 0) ELSE 0 END AS semantic_match, "
            f"CASE WHEN has_text THEN {_pct('len(matched)', 'len(sk)')} ELSE 0 END AS skill_match, "
            "CASE WHEN has_text THEN coalesce(keyword_match, 0) ELSE 0 END AS keyword_match, "
            "CASE WHEN has_text THEN title_match ELSE 0 END AS title_match, "
            "CASE WHEN has_text THEN experience_match ELSE 0 END AS experience_match, "
            "CASE WHEN has_text THEN education_bonus ELSE 0 END AS education_bonus, "
            "CASE WHEN has_text THEN matched ELSE [] END AS matched, CASE WHEN has_text THEN missing ELSE [] END AS missing "
            "FROM compared LEFT JOIN kw USING (posting_id, profile_id) LEFT JOIN cosines USING (posting_id, profile_id)"
        ),
        "rated": (
            "SELECT *, CASE WHEN has_text THEN "
            + _bounded(
                "(" + " + ".join(f"{name} * {weight!r}::DOUBLE" for name, weight in fixed.WEIGHTS.items()) + ")"
            )
            + " ELSE 0 END AS ats_score FROM signal"
        ),
        "scored": (
            "SELECT posting_id, profile_id, ats_score, semantic_match, skill_match, keyword_match, title_match, "
            f"experience_match, education_bonus, {_joined('matched')} AS matched_skills, {_joined('missing')} AS missing_skills, "
            "CASE WHEN NOT has_text THEN " + _quoted(fixed.NO_DESCRIPTION)
            + "".join(f" WHEN ats_score >= {bound} THEN {_quoted(text)}" for bound, text in fixed.RECOMMENDATIONS)
            + f" WHEN len(missing) > 0 THEN {_quoted(fixed.LOW_WITH_MISSING)} ELSE {_quoted(fixed.LOW_WITHOUT_MISSING)} END AS recommendation FROM rated"
        ),
        "one": "SELECT * FROM scored WHERE profile_id = 1",
        "best": (
            "SELECT *, (row_number() OVER (ORDER BY ats_score DESC, posting_id, profile_id))::INT AS rank FROM "
            "(SELECT * FROM one ORDER BY ats_score DESC, posting_id, profile_id LIMIT 10)"
        ),
        "cell": (
            f"SELECT posting_id, CASE WHEN regexp_matches({_strip(_coalesced('job_link'))}, '(?i)^https?://') "
            f"THEN '<a href=\"' || {_escape(_strip(_coalesced('job_link')))} || '\">' || {_escape(_coalesced('job_title'))} || '</a>' "
            f"ELSE {_escape(_coalesced('job_title'))} END AS cell FROM posting"
        ),
        "row_of_report": (
            "SELECT rank, '<tr><td>' || cell || '</td><td>' || ats_score::VARCHAR || '%</td><td>' || "
            f"{_escape('matched_skills')} || '</td><td>' || {_escape('recommendation')} || '</td></tr>' AS row_html "
            "FROM best JOIN cell USING (posting_id)"
        ),
        # Cards as the page texts were made: items of the supplied lists, one more inside
        # each item of every fourth page, and nothing outside the results.
        "item": (
            r"SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<li>.*?</li>')) AS item, "
            r"generate_subscripts(regexp_extract_all(html, '(?s)<li>.*?</li>'), 1) AS k, "
            r"len(regexp_extract_all(html, '(?s)<li>.*?</li>')) AS n, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM pages"
        ),
        "item_text": (
            "SELECT *, " + _squeeze(_decoded("regexp_extract(item, '(?s)<a[^>]*>(.*?)</a>', 1)")) + " AS label, "
            "CASE WHEN page_id % 4 = 2 THEN '/jobs/view/' || (700000 + page_id)::VARCHAR || '-' ELSE '/' END || "
            "substr(replace(regexp_extract(item, 'href=\"([^\"]*)\"', 1), '&amp;', '&'), 2) AS path FROM item"
        ),
        "card": (
            "SELECT page_id, url, (CASE WHEN page_id % 4 = 3 THEN 2 * k - 1 ELSE k END)::INT AS position, "
            "(CASE WHEN page_id % 4 = 3 THEN 2 * n ELSE n END)::INT AS total_cards, "
            "label || CASE WHEN page_id % 4 = 3 THEN ' inner tail' ELSE '' END AS job_title, "
            "array_to_string(list_transform(regexp_extract_all(origin || path, '[^\\x21-\\x7e]+|[\\x21-\\x7e]+'), "
            "lambda s: CASE WHEN regexp_matches(s, '[^\\x21-\\x7e]') THEN url_encode(s) ELSE s END), '') AS job_link, "
            "CASE page_id % 4 WHEN 0 THEN (500000 + page_id)::VARCHAR WHEN 1 THEN (600000 + page_id)::VARCHAR "
            "WHEN 2 THEN (700000 + page_id)::VARCHAR ELSE '' END AS job_id FROM item_text UNION ALL "
            "SELECT page_id, url, (2 * k)::INT, (2 * n)::INT, 'inner', '', '' FROM item WHERE page_id % 4 = 3"
        ),
        "fetched_page": tables.over_views(tables.FETCHED_FOR_PAGES),
        "with_id": tables.over_views(tables.CARDS_WITH_IDS),
        "every_attempt": tables.over_views(tables.FETCHED),
        "attempt": (
            "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, source ORDER BY "
            "CASE WHEN status < 400 AND text <> '' THEN 0 WHEN status < 400 THEN 1 WHEN status IN (403, 429) THEN 2 ELSE 3 END, "
            "status, text) AS nth FROM every_attempt) WHERE nth = 1"
        ),
        "payload_row": tables.over_views(tables.PAYLOADS),
        "setting_row": tables.over_views(tables.SETTINGS),
    }
    return steps


def _coalesced(column: str) -> str:
    return f"coalesce({column}, '')"


_ALL = "posting_id, profile_id, ats_score, semantic_match, skill_match, keyword_match, title_match, experience_match, education_bonus, matched_skills, missing_skills, recommendation"


def _finals() -> dict[str, str]:
    words = f"regexp_extract_all(d, '{fixed.TOKEN_PATTERN}')"
    page_head = "".join(f"<th>{name}</th>" for name in report.COLUMNS)
    opening = (
        f'<!doctype html><html><head><meta charset="utf-8"><title>{report.PAGE_TITLE}</title></head>'
        f"<body><h2>{report.PAGE_TITLE}</h2><table><thead><tr>{page_head}</tr></thead><tbody>"
    )
    url = search.SEARCH_TEMPLATE.replace("%d", "86400").split("%s")
    keyword_quoted = "replace(url_encode(p_name || ' & ' || p_type), '%2F', '/')"
    place_quoted = "replace(url_encode(p_brand || '/São*Paulo~'), '%2F', '/')"
    flag = f"{_strip('lower(setting)')} IN ({', '.join(map(_quoted, fixed.TRUE_FLAGS))})"
    similarity = (
        "list_cosine_similarity((SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {}), embedding::DOUBLE[]) * 100"
    )
    top = (
        "SELECT profile_id, posting_id, ats_score, rank FROM (SELECT *, (row_number() OVER ("
        "PARTITION BY profile_id ORDER BY ats_score DESC, posting_id))::INT AS rank FROM scored) WHERE rank <= 10"
    )
    capped = (
        "SELECT lang, doc_id, serial_number FROM (SELECT lang, doc_id, (row_number() OVER ("
        "PARTITION BY lang ORDER BY doc_id))::INT AS serial_number FROM documents) WHERE serial_number <= 100"
    )
    chosen = (
        "SELECT c.posting_id, CASE WHEN NOT (c.job_id = '' OR coalesce(g.status IN (403, 429), FALSE)) THEN "
        "CASE WHEN g.status < 400 AND coalesce(g.text, '') <> '' THEN 'page' "
        "WHEN j.status < 400 AND coalesce(j.text, '') <> '' THEN 'json' "
        "WHEN coalesce(c.ui_text, '') <> '' THEN 'ui' ELSE 'none' END "
        "WHEN coalesce(c.ui_text, '') <> '' THEN 'ui' ELSE 'none' END AS description_source, g.text AS page_text, j.text AS json_text, c.ui_text "
        "FROM with_id c LEFT JOIN (SELECT * FROM attempt WHERE source = 'page') g USING (job_id) "
        "LEFT JOIN (SELECT * FROM attempt WHERE source = 'json') j USING (job_id)"
    )
    cut = {"missing_skills": "array_to_string(string_split(missing_skills, ', ')[1:12], ', ')"}
    score_headers = ", ".join(
        f'{cut.get(ours, ours)} AS "{header}"' for ours, header in fixed.SCORE_HEADERS.items()
    )
    return {
        "posting_scan": "SELECT doc_id AS posting_id, '' AS job_title, '' AS job_link, md5(text) AS text_md5 FROM documents",
        "profile_text": f"SELECT conv_id AS profile_id, {_strip('string_agg(coalesce(text, %s), chr(10) ORDER BY turn)' % _quoted(''))} AS text FROM conversations GROUP BY conv_id",
        "html_text": r"SELECT page_id, " + _markup(r"regexp_extract(html, '(?s)<article\b[^>]*>(.*?)</article>', 1)") + " AS body FROM pages",
        "class_container_text": "SELECT page_id, 'Lead ' || " + _markup(r"regexp_extract(html, '(?s)<article\b[^>]*>(.*?)</article>', 1)") + " AS body FROM pages",
        "sheet_scan": "SELECT md5(text) AS text_md5, count(*) AS n, 1::BIGINT AS n_ids FROM documents GROUP BY md5(text)",
        "json_payload": (
            f"SELECT event_id, {_strip(_coalesced(_json('payload', '$.description.text')))} AS description, "
            f"nullif({_json('payload', '$.error')}, '') AS error, "
            f"nullif(regexp_extract({_json('payload', '$.error')}, '^HTTP (\\d{{3}})$', 1), '')::INT AS status, "
            f"{_strip(_coalesced(_json('props', '$.k')))} AS k FROM payload_row"
        ),
        "search_url": f"SELECT p_partkey, {_quoted(url[0])} || {keyword_quoted} || {_quoted(url[1])} || {place_quoted} || {_quoted(url[2])} AS url FROM part",
        "keyword_filter": (
            f"SELECT posting_id, location FROM posting WHERE contains({_normal('job_title')} || ' ' || {_normal('job_description')}, 'automation') "
            f"AND contains({_normal('job_title')} || ' ' || {_normal('job_description')}, 'engineer') AND lower(location) = 'en'"
        ),
        "recency": "SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 86400 SECOND",
        "recency_zone": "SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-30 01:30:00'",
        "first_100": "SELECT page_id, url, (row_number() OVER (ORDER BY page_id))::INT AS serial_number FROM (SELECT page_id, url FROM pages ORDER BY page_id LIMIT 100)",
        "first_per_search": capped,
        "total_cards": r"SELECT page_id, len(regexp_extract_all(html, '(?s)<li\b[^>]*>.*?</li>'))::INT AS total_cards FROM pages",
        "card_text": "SELECT page_id, position, total_cards, job_title FROM card",
        "page_link": "SELECT page_id, position, job_link FROM card",
        "page_base_link": "SELECT page_id, position, job_link FROM card",
        "page_id": "SELECT page_id, position, job_id FROM card",
        "source_fallback": (
            "SELECT posting_id, description_source, md5(CASE description_source WHEN 'page' THEN page_text "
            f"WHEN 'json' THEN json_text WHEN 'ui' THEN ui_text ELSE '' END) AS text_md5 FROM ({chosen})"
        ),
        "blocked": "SELECT page_id, url FROM pages WHERE contains(url, 'spam-farm')",
        "not_blocked": "SELECT page_id, url FROM pages WHERE url IS NULL OR NOT contains(url, 'spam-farm')",
        "normalize_text": f"SELECT posting_id, d AS normal, {_squeeze('job_title')} AS title_on_one_line FROM p0",
        "tokens": f"SELECT posting_id, len({words})::INT AS n, md5(array_to_string({words}, ' ')) AS words_md5 FROM p0",
        "token_filter": "SELECT posting_id, pos::INT AS position, token FROM word",
        "flag_parse": f"SELECT event_id, coalesce({flag}, FALSE) AS off_by_default, coalesce({flag}, TRUE) AS on_by_default FROM setting_row",
        "bounded_pct": f"SELECT event_id, {_bounded('(value * 1.7::DOUBLE - 10)')} AS pct FROM events",
        "percentage": f"SELECT l_orderkey, l_linenumber, {_pct('l_linenumber - 1', 'l_quantity - 1')} AS pct FROM lineitem",
        "list_join": f"SELECT posting_id, {_joined(words)} AS joined FROM p0",
        "skill_extraction": f"SELECT posting_id, {_joined('sk')} AS skills FROM p",
        "skill_tokens": (
            f"SELECT posting_id, {_joined('list_filter(%s, lambda s: contains(words, concat(chr(32), s, chr(32))))' % _list(sorted(fixed.SKILLS)))} AS skills "
            f"FROM (SELECT posting_id, ' ' || array_to_string({words}, ' ') || ' ' AS words FROM p0)"
        ),
        "large_vocabulary": (
            f"SELECT id, {_joined('found')} AS terms FROM (SELECT id, list_sort(list_filter((SELECT list(DISTINCT term) FROM vocabulary "
            "WHERE term <> ''), lambda t: contains(text, t))) AS found FROM text_with_part) WHERE len(found) > 0"
        ),
        "large_vocabulary_tokens": (
            "SELECT id, string_agg(term, ', ' ORDER BY term) AS terms FROM (SELECT DISTINCT term, "
            f"' ' || array_to_string(regexp_extract_all(term, '{fixed.TOKEN_PATTERN}'), ' ') || ' ' AS sought FROM vocabulary) v "
            f"JOIN (SELECT id, ' ' || array_to_string(regexp_extract_all(text, '{fixed.TOKEN_PATTERN}'), ' ') || ' ' AS words FROM text_with_part) d "
            "ON contains(words, sought) WHERE trim(sought) <> '' GROUP BY id"
        ),
        "skill_sets": f"SELECT posting_id, profile_id, {_joined('matched')} AS matched, {_joined('missing')} AS missing, {_joined('missing[1:12]')} AS shown FROM compared",
        "skill_match": f"SELECT posting_id, profile_id, {_pct('len(matched)', 'len(sk)')} AS skill_match FROM compared",
        "term_freq": "SELECT posting_id, token, n, first_pos::INT AS first_pos FROM term",
        "boosted_terms": "SELECT posting_id, token, weight FROM weighed",
        "top_keywords": "SELECT posting_id, token, weight, rank FROM keyword",
        "keyword_match": "SELECT posting_id, profile_id, coalesce(keyword_match, 0) AS keyword_match FROM pair LEFT JOIN kw USING (posting_id, profile_id)",
        "title_match": "SELECT posting_id, profile_id, title_match FROM compared",
        "max_years": "SELECT posting_id, yrs AS years FROM p",
        "experience_match": "SELECT posting_id, profile_id, experience_match FROM compared",
        "experience_override": (
            "SELECT posting_id, profile_id, CASE WHEN d = '' THEN 0.0::DOUBLE WHEN yrs IS NULL OR yrs <= 2 THEN 100.0::DOUBLE "
            f"ELSE {_pct('2.0', 'yrs')} END AS experience_match FROM pair"
        ),
        "required_education": f"SELECT posting_id, {_joined('ed')} AS required FROM p",
        "education_bonus": "SELECT posting_id, profile_id, education_bonus FROM compared",
        "text_embedding": "SELECT posting_id, bucket, weight FROM vec",
        "semantic_match": "SELECT posting_id, profile_id, semantic_match FROM signal",
        "cosine_match": f"SELECT vec_id, {_bounded(similarity.format(0))} AS cosine FROM embeddings",
        "stored_vectors": (
            "SELECT posting_id, profile_id, sem AS semantic_match, CASE WHEN has_text THEN "
            + _bounded(
                "(sem * 0.25::DOUBLE + " + " + ".join(
                    f"{name} * {weight!r}::DOUBLE" for name, weight in fixed.WEIGHTS.items() if name != "semantic_match"
                ) + ")"
            )
            + " ELSE 0 END AS ats_score FROM (SELECT s.*, CASE WHEN has_text THEN coalesce("
            + _bounded("(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) * 100)")
            + ", 0) ELSE 0 END AS sem FROM signal s LEFT JOIN embeddings a ON a.vec_id = s.posting_id "
            "LEFT JOIN embeddings b ON b.vec_id = s.profile_id)"
        ),
        "pairing": "SELECT posting_id, profile_id FROM pair",
        "pairing_by_key": (
            "SELECT posting_id, profile_id, posting.location FROM posting JOIN (SELECT profile_id, "
            "['en', 'de', 'fr', 'none'][profile_id] AS location FROM profile_text) USING (location)"
        ),
        "no_description": f"SELECT {_ALL} FROM scored WHERE recommendation = {_quoted(fixed.NO_DESCRIPTION)}",
        "full_score": f"SELECT {_ALL} FROM scored",
        "one_profile_score": f"SELECT {_ALL} FROM one",
        "recommendation": "SELECT profile_id, recommendation, count(*) AS n FROM scored GROUP BY profile_id, recommendation",
        "score_columns": (
            'SELECT posting_id, location, profile_id, coalesce(job_title, \'\') AS "Job Title", job_link AS "Job Link", md5(job_description) AS "Job Description", '
            f"{score_headers} FROM one JOIN posting USING (posting_id)"
        ),
        "total_sort": "SELECT posting_id, ats_score FROM one ORDER BY ats_score DESC, posting_id",
        "top10": f"SELECT {_ALL} FROM best",
        "top_per_profile": top,
        "top_per_profile_pruned": top,
        "preview": "SELECT job_title, ats_score, recommendation FROM best JOIN posting USING (posting_id)",
        "html_escape": f"SELECT page_id, {_escape('html')} AS escaped FROM pages",
        "title_cell": "SELECT posting_id, cell FROM cell",
        "report_rows": "SELECT rank, row_html FROM row_of_report",
        "report_html": f"SELECT {_quoted(opening)} || string_agg(row_html, '' ORDER BY rank) || '</tbody></table></body></html>' AS html FROM row_of_report",
        "scored_sink": f"SELECT {_ALL} FROM one",
        "safe_path": "SELECT posting_id, job_title, TRUE AS moved FROM posting",
        "batch_run": f"SELECT {_ALL} FROM best",
        "pages_to_postings": (
            "SELECT page_id, position, total_cards, job_title, job_link, job_id, "
            "CASE description_source WHEN 'page' THEN page_text WHEN 'json' THEN json_text WHEN 'ui' THEN job_title ELSE '' END AS job_description, "
            "description_source FROM (SELECT c.*, g.text AS page_text, j.text AS json_text, CASE "
            "WHEN c.job_id <> '' AND coalesce(g.status, 200) NOT IN (403, 429) AND coalesce(g.text, '') <> '' THEN 'page' "
            "WHEN c.job_id <> '' AND coalesce(g.status, 200) NOT IN (403, 429) AND coalesce(j.text, '') <> '' THEN 'json' "
            "WHEN c.job_title <> '' THEN 'ui' ELSE 'none' END AS description_source FROM card c "
            "LEFT JOIN (SELECT * FROM fetched_page WHERE source = 'page') g USING (job_id) "
            "LEFT JOIN (SELECT * FROM fetched_page WHERE source = 'json') j USING (job_id) WHERE NOT contains(c.url, 'spam-farm'))"
        ),
        "incremental": f"SELECT {_ALL} FROM one",
        "incremental_top": f"SELECT {_ALL} FROM best",
        "batch_run_many": (
            f"SELECT {_ALL}, rank FROM (SELECT *, (row_number() OVER (PARTITION BY profile_id "
            "ORDER BY ats_score DESC, posting_id))::INT AS rank FROM scored) WHERE rank <= 10"
        ),
        "batch_run_filtered": (
            f"SELECT {_ALL}, rank FROM (SELECT scored.*, (row_number() OVER (PARTITION BY profile_id "
            "ORDER BY ats_score DESC, posting_id))::INT AS rank FROM scored JOIN posting USING (posting_id) "
            "WHERE lower(location) = 'en' AND posting_id % 40 >= 16 AND (contains(lower(job_title), 'automation') "
            "OR contains(lower(job_description), 'automation'))) WHERE rank <= 10"
        ),
        "run_reports": (
            f"SELECT profile_id, {_quoted(opening)} || string_agg('<tr><td>' || cell || '</td><td>' || ats_score::VARCHAR || "
            f"'%</td><td>' || {_escape('matched_skills')} || '</td><td>' || {_escape('recommendation')} || '</td></tr>', '' ORDER BY rank) "
            "|| '</tbody></table></body></html>' AS html FROM (SELECT *, row_number() OVER (PARTITION BY profile_id "
            "ORDER BY ats_score DESC, posting_id) AS rank FROM scored) JOIN cell USING (posting_id) WHERE rank <= 10 GROUP BY profile_id"
        ),
        "display_sink": (
            'SELECT posting_id, profile_id, location, coalesce(job_title, \'\') AS "Job Title", md5(coalesce(job_description, \'\')) AS text_md5, '
            'ats_score AS "ATS Score", matched_skills AS "Matched Skills", '
            f'{cut["missing_skills"]} AS "Missing Skills", recommendation AS "Recommendation" '
            "FROM one JOIN posting USING (posting_id)"
        ),
        "pairing_many": (
            "SELECT profile_id, posting_id, ats_score, rank FROM (SELECT *, (row_number() OVER ("
            "PARTITION BY profile_id ORDER BY ats_score DESC, posting_id))::INT AS rank FROM scored) WHERE rank <= 3"
        ),
    }


def _json(column: str, path: str) -> str:
    return f"json_extract_string({column}, '{path}')"


def _needed(sql: str, steps: dict[str, str]) -> list[str]:
    """Steps that a text uses, directly or through others, in their order."""
    names = list(steps)
    found: set[str] = set()
    queue = [sql]
    while queue:
        text = queue.pop()
        for name in names:
            if name not in found and re.search(rf"\b(?:FROM|JOIN|,)\s*{name}\b", text):
                found.add(name)
                queue.append(steps[name])
    return [name for name in names if name in found]


#: Steps that some queries take from other tables.
_CHATS = (
    "SELECT * FROM (SELECT conv_id AS profile_id, "
    + _strip("string_agg(coalesce(text, ''), chr(10) ORDER BY turn)")
    + " AS text FROM conversations GROUP BY conv_id) WHERE text <> ''"
)
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin"
OTHER_STEPS = {
    "page_base_link": lambda steps: {
        "item": steps["item"].replace(_ORIGIN, "regexp_extract(url, '^[a-z]+:', 0) || '//base.example.org' AS origin")},
    "pairing_many": {"profile_text": _CHATS},
    "top_per_profile_pruned": {"profile_text": f"SELECT profile_id, text || {tables.CHAT_TAIL} AS text FROM ({_CHATS})"},
}


def all_sql() -> dict[str, str]:
    result = {}
    for name, sql in _finals().items():
        steps = _steps()
        other = OTHER_STEPS.get(name, {})
        steps |= other(steps) if callable(other) else other
        used = _needed(sql, steps)
        head = ",\n".join(f"{step} AS ({steps[step]})" for step in used)
        result[name] = f"WITH {head}\n{sql}" if used else sql
    return result
