"""The same results in DuckDB SQL, written against the given tables."""

from __future__ import annotations

import re

from digitscope.rules.categories import BAND_BOUNDS, CATEGORIES
from digitscope.rules.declared_rules import DECLARED_RULES
from digitscope.rules.domains import DEFAULT_DOMAIN, DOMAIN_KEYWORDS
from digitscope.rules.expected import EXPECTED, equal_size_ks_pvalues
from digitscope.rules.number_rules import OBSERVED_RULES, TRIGGERS
from digitscope.rules.units import unit_rows
from suite.inputs import DIGIT_HEADS, KINDS, SENTENCES, UNIT_PHRASES, WIKITEXT


# Numbers: runs that start with 0 or are longer than 16 digits are read as a whole and dropped.
TOKEN = "0[0-9]*|[1-9][0-9]{16,}|[1-9][0-9]{0,15}(?:[.][0-9]+)?"
NOT_A_NUMBER = "^(0|[1-9][0-9]{16,})"

# What the given wiki texts hold, in the order it is removed: comments, three levels of templates, links,
# table lines, outer links, tags, quotes, headings, list marks.
WIKI_REMOVED = (
    ("(?s)<!--.*?-->", ""), *[("[{][{][^{}]*[}][}]", "")] * 3, *[("\\[\\[(?:[^\\[\\]|]*[|])?([^\\[\\]]*)\\]\\]", "$1")] * 3,
    ("(?m)^[ \t]*[{][|][^\n]*$", ""), ("(?m)^[ \t]*[|][-+}][^\n|]*", ""), ("[|][|]", "\n|"),
    ("(?m)^[ \t]*[|](?:[^\n|\\[\\]]*[|])?", " "), ("(?m)^[ \t]*!(?:[^\n|\\[\\]]*[|])?|!!", " "),
    ("\\[(?:https?:|ftp:|mailto:)?//[^\\s\\[\\]]*\\s*([^\\[\\]]*)\\]", "$1"), ("</?[A-Za-z][^<>]*>", ""), ("''+", ""),
    ("(?m)^={1,6}([^\n]*?)={1,6}[ \t]*$", "$1"), ("(?m)^[*#:;]+", ""), ("\n\n\n+", "\n\n"),
)
HTML_REMOVED = (("(?is)<script[^<>]*>.*?</script *>", " "), ("(?is)<style[^<>]*>.*?</style *>", " "), ("(?s)<!--.*?-->", " "), ("(?s)<[^<>]*>", " "))
INFOBOX = "(?s)<!--.*?-->|[{][{]\\s*[Ii][Nn][Ff][Oo][Bb][Oo][Xx]\\s*([^|{}\\s][^|{}]*)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) if isinstance(v, str) else "NULL" if v is None else repr(v) for v in values) + "]"


# -- pieces ------------------------------------------------------------------------------------

def _first(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN CAST(substr(format('{{:.14e}}', {x}), 1, 1) AS INTEGER) ELSE 0 END"


def _second(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN CAST(substr(format('{{:.14e}}', {x}), 3, 1) AS INTEGER) ELSE 0 END"


def _re2(pattern: str) -> str:
    """Unicode classes spelled out; a word boundary becomes the neighbouring character or an end of the text."""
    out = re.sub(r"(^|\|)\\b", r"\1(?:^|[^\\pL\\pN_])", pattern)
    out = out.replace(r"\b", r"(?:[^\pL\pN_]|$)").replace(r"\d", r"\p{Nd}")
    return "(?i)" + out.replace(r"\s", r"[\s\x1c-\x1f\x{85}\pZ]")


def _words(words) -> str:
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def _year(number: str) -> str:
    return f"CASE WHEN trunc({number}) BETWEEN 1000 AND 2100 THEN 'year' ELSE 'generic' END"


def _category(number: str, context: str) -> str:
    low = f"lower({context})"
    cases = [f"WHEN NOT regexp_matches({low}, {_q(_words(TRIGGERS))}) THEN {_year(number)}"]
    for category, pattern, words in OBSERVED_RULES:
        hit = f"regexp_matches({context}, {_q(_re2(pattern))})"
        if words:
            hit = f"regexp_matches({low}, {_q(_words(words))}) AND {hit}"
        cases.append(f"WHEN {hit} THEN '{category}'")
    return f"CASE {' '.join(cases)} ELSE {_year(number)} END"


def _declared(number: str, context: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({context}, {_q(_re2(pattern))}) THEN '{category}'" for category, pattern in DECLARED_RULES)
    return f"CASE {cases} ELSE {_year(number)} END"


def _numbers(source: str, text: str, *keys: str) -> str:
    """CTEs ending in ``nums``: keys, token, number, positions and context."""
    k = ", ".join(keys)
    return f"""
cut AS (SELECT {k}, {text} AS body, regexp_extract_all({text}, {_q(TOKEN)}) AS toks,
               regexp_split_to_array({text}, {_q(TOKEN)}) AS gaps
        FROM {source} WHERE regexp_matches({text}, '[1-9]')),
pos AS (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM cut),
loc AS (SELECT *, toks[i] AS token, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
               + coalesce(list_sum(list_transform(toks[1:i-1], lambda t: length(t))), 0) AS BIGINT) AS start_pos FROM pos),
nums AS (SELECT {k}, token, CAST(token AS DOUBLE) AS number, start_pos, start_pos + length(token) AS end_pos,
                substring(body, greatest(start_pos - 30, 0) + 1,
                          start_pos + length(token) + 30 - greatest(start_pos - 30, 0)) AS context
         FROM loc WHERE NOT regexp_matches(token, {_q(NOT_A_NUMBER)}) AND CAST(token AS DOUBLE) < 1e16)"""


DOC_NUMBERS = _numbers("documents", "text", "doc_id", "lang", "source")

MEASURED = f"""
measured AS (
  SELECT l_orderkey, l_linenumber, number_text, CAST(number_text AS DOUBLE) AS number, sentence,
         replace(sentence, '{{}}', number_text) AS context,
         substr(sentence, strpos(sentence, '{{}}') + 2) AS after
  FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR)
                       ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS number_text,
               ({_list(SENTENCES)})[(l_orderkey * 7 + l_linenumber) % {len(SENTENCES)} + 1] AS sentence
        FROM lineitem))"""

_parts = {"KIND": f"({_list(KINDS)})[doc_id % {len(KINDS)} + 1]", "ID": "doc_id", "SIZE": "n_chars", "LANG": "lang",
          "SOURCE": "source", "TEXT": "text"}
WIKI = f"""
wiki AS (SELECT doc_id, concat({', '.join(_parts.get(p, _q(p)) for p in WIKITEXT)}) AS wikitext FROM documents)"""

INDEX = """
lines AS (SELECT CASE WHEN doc_id % 17 = 3 OR doc_id % 19 = 5 THEN NULL
                      ELSE [CAST(CAST(floor(doc_id / 100) AS BIGINT) * 5000 + 616 AS VARCHAR), CAST(doc_id AS VARCHAR)] END AS p,
                 source || ':' || lang AS title FROM documents),
entries AS (SELECT CAST(p[1] AS BIGINT) AS "offset", CAST(p[2] AS BIGINT) AS article_id, title FROM lines WHERE p IS NOT NULL)"""


def _hash(seed: int) -> str:
    return f"substr(md5('{seed}:' || article_id), 1, 13), article_id"


def _stages(text: str, stages) -> str:
    for pattern, replacement in stages:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(replacement.replace('$', chr(92)))}, 'g')"
    return text


def _plain_wikitext(text: str) -> str:
    return f"trim({_stages(text, WIKI_REMOVED)}, chr(10))"


def _plain_html(text: str) -> str:
    out = _stages(text, HTML_REMOVED)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = f"replace({out}, '&{name};', {_q(char)})"
    return out


def _infobox(text: str) -> str:
    names = f"list_transform(regexp_extract_all({text}, {_q(INFOBOX)}, 1), lambda n: lower(trim(n, chr(10) || chr(9) || ' ')))"
    return f"list_filter({names}, lambda n: n <> '')[1]"


def _domain(kind: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({kind}, {_q('(?i)(?:^|[^A-Za-z0-9_])(?:' + _words(words) + ')(?:[^A-Za-z0-9_]|$)')}) THEN '{domain}'"
        for domain, words in DOMAIN_KEYWORDS)
    return f"CASE {cases} ELSE '{DEFAULT_DOMAIN}' END"


# -- distributions: from a relation ``digits`` with the group columns and first_digit --------------

_EXPECTED = ", ".join(f"({d}, CAST({e} AS DOUBLE))" for d, e in EXPECTED.items())


def _dense(by: str, relation: str = "digits") -> str:
    """CTE ``dense``: group, digit, count, n, observed, expected."""
    keys = [k.strip() for k in by.split(",") if k.strip()]
    pick = ", ".join(f"g.{k}" for k in keys) + ("," if keys else "")
    join = " AND ".join([f"g.{k} IS NOT DISTINCT FROM c.{k}" for k in keys] + ["e.digit = c.first_digit"])
    group = f"GROUP BY {by}" if keys else ""
    select = f"{by}," if keys else ""
    return f"""
valid AS (SELECT * FROM {relation} WHERE first_digit BETWEEN 1 AND 9),
g AS (SELECT {select} count(*) AS n FROM valid {group}),
c AS (SELECT {select} first_digit, count(*) AS cnt FROM valid GROUP BY {select} first_digit),
e(digit, expected) AS (VALUES {_EXPECTED}),
dense AS (SELECT {pick} e.digit, coalesce(c.cnt, 0) AS "count", g.n, coalesce(c.cnt, 0) / g.n AS observed, e.expected
          FROM g CROSS JOIN e LEFT JOIN c ON {join})"""


_CHI = "n * sum((observed - expected) * (observed - expected) / expected)"


def _pvalue(chi: str) -> str:
    h = f"({chi} / 2)"
    return f"exp(-{h}) * (1 + {h} + {h} * {h} / 2 + {h} * {h} * {h} / 6)"


def _summary(ctes: str, by: str) -> str:
    return f"""WITH {ctes}, {_dense(by)},
s AS (SELECT {by}, n, {_CHI} AS chi, avg(abs(observed - expected)) AS m FROM dense GROUP BY {by}, n)
SELECT {by}, n AS samples, round(chi, 6) AS chi_square, round({_pvalue('chi')}, 6) AS p_value, round(m, 6) AS mad,
       CASE WHEN {_pvalue('chi')} > 0.05 THEN 'Yes' ELSE 'No' END AS follows_law FROM s"""


PRICES = f"digits AS (SELECT l_returnflag, l_linestatus, {_first('l_extendedprice')} AS first_digit, {_second('l_extendedprice')} AS second_digit FROM lineitem)"
DOC_DIGITS = f"{DOC_NUMBERS}, digits AS (SELECT lang AS domain, source, doc_id, {_first('number')} AS first_digit FROM nums)"

_MATRIX = "max(CASE WHEN digit = {d} THEN {value} END) AS digit_{d}"


def _preview() -> str:
    return f"firstdocs AS (SELECT * FROM documents ORDER BY doc_id LIMIT 1000), {_numbers('firstdocs', 'text', 'doc_id', 'lang')}"


def _wiki_numbers() -> str:
    return f"""{WIKI},
stripped AS (SELECT doc_id, {_domain(_infobox('wikitext'))} AS domain, {_plain_wikitext('wikitext')} AS text FROM wiki),
{_numbers('stripped', 'text', 'doc_id', 'domain')}"""


def _conformity() -> str:
    bounds = ", ".join(
        f"('{name}', '{group}', '{band}', {'NULL' if BAND_BOUNDS[band][0] is None else BAND_BOUNDS[band][0]}::DOUBLE, "
        f"{'NULL' if BAND_BOUNDS[band][1] is None else BAND_BOUNDS[band][1]}::DOUBLE)"
        for name, group, band, *_ in CATEGORIES)
    return f"dim(number_category, category_group, expected_mad, lo, hi) AS (VALUES {bounds})"


def _value_stats(relation: str) -> str:
    return f"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos,
                   count(*) OVER (PARTITION BY event_type) AS n FROM {relation} WHERE value IS NOT NULL)
            SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
                   round(max(CASE WHEN pos = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) THEN value END), 6) AS p95,
                   round(max(value), 6) AS max, count(*) AS "count" FROM r GROUP BY 1"""


def _units() -> str:
    rows = ", ".join(f"({_q(u)}, {_q(m)})" for u, m in unit_rows(units_only=True))
    return f"vocab(unit, measure) AS (VALUES {rows})"


_WORD = r"[^\s\x{a0},;:!?()\[\]]+"


def _candidate(extra: int) -> str:
    pattern = rf"^[\s\x{{a0}}]?({_WORD}(?: {_WORD}){{{extra}}})"
    return f"regexp_replace(regexp_extract(after, {_q(pattern)}, 1), '\\.+$', '')"


# The faulty dump as it is built, and the first reason to reject a page.
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
FAULTY = f"""made AS (SELECT page_id AS p, '<page>' || chr(10) || '<title>' || {_ESCAPED.format('url')} || '</title>' || CASE WHEN page_id % 7 = 2 THEN '' ELSE '<ns>' || page_id % 4 % 3 || '</ns>' END
        || CASE WHEN page_id % 11 = 5 THEN '' ELSE '<id> ' || CASE WHEN page_id % 19 = 3 THEN 'x' WHEN page_id % 19 = 4 THEN '99999999999999999999' ELSE page_id::VARCHAR END || ' </id>' END
        || '<revision><id>5</id>' || CASE WHEN page_id % 13 = 6 THEN '' ELSE '<text>' || {_ESCAPED.format('html')} || '</text>' END
        || CASE WHEN page_id % 17 = 8 THEN '<b>' ELSE '</revision>' END || '</page>' AS page FROM pages),
    judged AS (SELECT page, reason, CASE WHEN p % 11 <> 5 AND p % 19 NOT IN (3, 4) THEN (p // 100)::VARCHAR END AS unit FROM (SELECT *, CASE
        WHEN p % 7 <> 2 AND p % 4 % 3 <> 0 THEN 'other_namespace' WHEN p % 17 = 8 THEN 'bad_xml' WHEN p % 7 = 2 THEN 'no_namespace'
        WHEN p % 11 = 5 THEN 'no_id' WHEN p % 19 IN (3, 4) THEN 'bad_id' WHEN p % 13 = 6 THEN 'no_text' END AS reason FROM made))"""


def oracle_sql() -> dict[str, str]:
    ks_table = [p for _, p in sorted(equal_size_ks_pvalues().items())]
    nine = range(1, 10)
    return {
        "has_numbers": "SELECT doc_id, regexp_matches(text, '[1-9]') AS has_number FROM documents",
        "index_parse": f"WITH {INDEX} SELECT * FROM entries",
        "xml_articles": "SELECT page_id AS article_id, url AS title, md5(html) AS text_md5 FROM pages "
                        "WHERE page_id % 3 = 0 AND page_id % 5 <> 4",
        "dump_articles": "SELECT page_id AS article_id, url AS title, md5(html) AS text_md5 FROM pages WHERE page_id % 3 = 0 AND page_id % 5 <> 4",
        "rejected_pages": f"WITH {FAULTY} SELECT coalesce(unit, 'no id') AS unit_id, reason, sha256(page) AS digest FROM judged WHERE reason IS NOT NULL",
        "rejected_by_reason": f"WITH {FAULTY} SELECT reason, count(*) AS pages FROM judged WHERE reason IS NOT NULL GROUP BY reason",
        "units_completed": f"""WITH {DOC_NUMBERS}, per AS (SELECT documents.source, count(DISTINCT doc_id) AS articles, count(*) AS numbers FROM nums JOIN documents USING (doc_id) GROUP BY documents.source)
            SELECT source AS unit_id, CASE WHEN source = 'src3' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN source = 'src3' THEN 0 ELSE coalesce(articles, 0) END AS articles,
                   CASE WHEN source = 'src3' THEN 0 ELSE coalesce(numbers, 0) END AS numbers, 0::INTEGER AS retries
            FROM (SELECT DISTINCT source FROM documents) LEFT JOIN per USING (source)""",
        "sampled_dump": "SELECT page_id AS article_id, url AS title, md5(html) AS text_md5 FROM pages WHERE page_id % 3 = 0 AND page_id % 5 <> 4 AND page_id % 9 = 0",
        "group_value_stats_close": """WITH v AS (SELECT event_type, epoch_us(ts) AS value FROM events),
            o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM v)
            SELECT event_type, CAST(floor((max(value::DOUBLE) FILTER (i = (n - 1) // 2) + max(value::DOUBLE) FILTER (i = n // 2)) / 2) AS BIGINT) AS median,
                   max(value) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, max(value) AS max, count(*) AS count FROM o GROUP BY event_type""",
        "numbers_written": f"WITH {DOC_NUMBERS} SELECT doc_id AS article_id, lang AS domain, number, {_category('number', 'context')} AS number_category, "
                           f"{_first('number')} AS first_digit, {_second('number')} AS second_digit FROM nums",
        "counts_json": f"""WITH {DOC_DIGITS}, c AS (SELECT domain, first_digit, count(*) AS n FROM digits WHERE first_digit > 0 GROUP BY ALL)
            SELECT '{{"' || domain || '":{{' || string_agg('"' || first_digit || '":' || n, ',' ORDER BY first_digit) || '}}}}' AS counts FROM c GROUP BY domain""",
        "numbers_from_documents": f"WITH {DOC_NUMBERS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_pos) - 1 AS INTEGER) AS position, number FROM nums",
        "numbers_from_conversations": "WITH told AS (SELECT conv_id, turn, (turn * 7 + 1) || ' of ' || length(text) || '.5: ' || text AS text FROM conversations), "
                                      f"{_numbers('told', 'text', 'conv_id', 'turn')} SELECT conv_id, turn, number FROM nums",
        "strip_wikitext_deep": """SELECT doc_id, 'Seen ' || CASE WHEN doc_id % 40 = 0 THEN ' 41 ' ELSE '' END || ' 7' || repeat('u ', (doc_id % 23)::INTEGER) || lang
            || ' [5]  }} ' || doc_id || ' {{open {n} }' AS text FROM documents""",
        "digits_near_powers": f"""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(({_list(DIGIT_HEADS)})[l_orderkey % {len(DIGIT_HEADS)} + 1]
                || repeat('9', (9 + l_linenumber % 4)::INTEGER) || (l_orderkey % 3 * 3 + 1) || 'e' || (l_orderkey % 41 - 15) AS DOUBLE) AS x FROM lineitem)
            SELECT l_orderkey, l_linenumber, {_first('x')} AS first_digit, {_second('x')} AS second_digit FROM v""",
        "number_contexts": f"WITH {DOC_NUMBERS} SELECT doc_id, token, number, context, start_pos, end_pos FROM nums",
        "number_categories": f"WITH {DOC_NUMBERS} SELECT doc_id, number, {_category('number', 'context')} AS number_category, start_pos FROM nums",
        "measured_categories": f"WITH {MEASURED} SELECT l_orderkey, l_linenumber, context, {_category('number', 'context')} AS number_category FROM measured",
        "declared_categories": f"WITH {MEASURED} SELECT l_orderkey, l_linenumber, {_declared('number', 'context')} AS number_category FROM measured",
        "document_declared_categories": f"WITH {DOC_NUMBERS} SELECT lang AS domain, {_declared('number', 'context')} AS number_category, count(*) AS numbers FROM nums GROUP BY 1, 2",
        "year_heuristic": f"SELECT o_orderkey, {_year('round(o_totalprice / 100, 2)')} AS label FROM orders",
        "numbers_table": f"WITH {DOC_NUMBERS} SELECT doc_id AS article_id, lang AS domain, number, {_category('number', 'context')} AS number_category, "
                         f"{_first('number')} AS first_digit, {_second('number')} AS second_digit, source FROM nums",
        "strip_html": f"SELECT page_id, {_plain_html('html')} AS text FROM pages",
        "html_numbers": f"WITH plain AS (SELECT page_id, {_plain_html('html')} AS text FROM pages WHERE regexp_matches(html, '[1-9]')), "
                        f"{_numbers('plain', 'text', 'page_id')} SELECT page_id AS article_id, number, {_first('number')} AS first_digit, {_second('number')} AS second_digit FROM nums",
        "strip_wikitext": f"WITH {WIKI} SELECT doc_id, {_plain_wikitext('wikitext')} AS text FROM wiki",
        "infobox_type": f"WITH {WIKI} SELECT doc_id, {_infobox('wikitext')} AS infobox_type FROM wiki",
        "domain_of_text": f"WITH {WIKI} SELECT doc_id, {_domain(_infobox('wikitext'))} AS domain FROM wiki",
        "domain_label": f"SELECT o_orderkey, {_domain(f'({_list(KINDS)})[o_orderkey % {len(KINDS)} + 1]')} AS domain FROM orders",
        "rule_label": "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)(?:steel|copper|brass|nickel|tin)') THEN 'metal' "
                      "WHEN regexp_matches(p_type, '(?i)^(?:small|standard)') THEN 'plain' ELSE 'other' END AS label FROM part",
        "domain_summary": _summary(f"{_wiki_numbers()}, digits AS (SELECT domain, {_first('number')} AS first_digit FROM nums)", "domain"),
        "digits_lineitem": f"SELECT l_orderkey, l_linenumber, {_first('l_extendedprice')} AS first_digit, {_second('l_extendedprice')} AS second_digit, "
                           f"{_first('l_discount')} AS discount_first, {_second('l_discount')} AS discount_second FROM lineitem",
        "digits_acctbal": f"SELECT c_custkey, {_first('c_acctbal')} AS first_digit, {_second('c_acctbal')} AS second_digit FROM customer",
        "digit_counts": f'WITH {PRICES} SELECT l_returnflag, first_digit, count(*) AS "count" FROM digits WHERE first_digit > 0 GROUP BY ALL',
        "second_digit_counts": f'WITH {PRICES} SELECT l_returnflag, second_digit, count(*) AS "count" FROM digits GROUP BY ALL',
        "document_digit_counts": f'WITH {DOC_DIGITS} SELECT domain, source, first_digit, count(*) AS "count" FROM digits WHERE first_digit > 0 GROUP BY ALL',
        "digit_counts_map": f"""WITH {PRICES}, c AS (SELECT l_returnflag, first_digit, count(*) AS n FROM digits WHERE first_digit > 0 GROUP BY ALL)
            SELECT l_returnflag, '{{' || string_agg('"' || first_digit || '":' || n, ',' ORDER BY first_digit) || '}}' AS digit_counts FROM c GROUP BY 1""",
        "frequencies": f'WITH {DOC_DIGITS}, {_dense("domain")} SELECT domain, n, digit, "count", round(observed, 6) AS observed, expected FROM dense',
        "frequencies_one_group": f"WITH {DOC_DIGITS}, english AS (SELECT * FROM digits WHERE domain = 'en'), {_dense('', 'english')} "
                                 'SELECT n, digit, "count", round(observed, 6) AS observed, expected FROM dense',
        "chi_square": f"""WITH {PRICES}, {_dense('l_returnflag, l_linestatus')},
            s AS (SELECT l_returnflag, l_linestatus, n, {_CHI} AS chi FROM dense GROUP BY l_returnflag, l_linestatus, n)
            SELECT l_returnflag, l_linestatus, n, round(chi, 6) AS chi_square, round({_pvalue('chi')}, 6) AS p_value FROM s""",
        "mad": f"WITH {PRICES}, {_dense('l_returnflag, l_linestatus')} SELECT l_returnflag, l_linestatus, n, "
               "round(avg(abs(observed - expected)), 6) AS mad FROM dense GROUP BY ALL",
        "mad_band": f"""WITH digits AS (SELECT event_type, {_first('value')} AS first_digit FROM events), {_dense('event_type')},
            s AS (SELECT event_type, n, avg(abs(observed - expected)) AS m FROM dense GROUP BY ALL)
            SELECT event_type, n, round(m, 6) AS mad, CASE WHEN m < 0.006 THEN 'close' WHEN m < 0.012 THEN 'acceptable'
                   WHEN m <= 0.015 THEN 'marginal' ELSE 'non-conforming' END AS mad_band FROM s""",
        "ks": f"""WITH {PRICES}, {_dense('l_returnflag')},
            w AS (SELECT *, sum(observed) OVER (PARTITION BY l_returnflag ORDER BY digit) AS oc,
                            sum(expected) OVER (PARTITION BY l_returnflag ORDER BY digit) AS ec FROM dense),
            s AS (SELECT l_returnflag, n, max(abs(oc - ec)) AS stat, list(observed) AS o, list(expected) AS e FROM w GROUP BY ALL)
            SELECT l_returnflag, n, round(stat, 6) AS ks_stat,
                   round(({ks_table})[CAST(list_max(list_transform(list_concat(o, e), lambda x: abs(len(list_filter(o, lambda v: v <= x))
                   - len(list_filter(e, lambda v: v <= x))))) AS INTEGER) + 1], 6) AS ks_p_value FROM s""",
        "cumulative_frequencies": f"""WITH {PRICES}, {_dense('l_returnflag')}
            SELECT l_returnflag, digit, round(sum(observed) OVER w, 6) AS observed_upto, round(sum(expected) OVER w, 6) AS expected_upto
            FROM dense WINDOW w AS (PARTITION BY l_returnflag ORDER BY digit)""",
        "summary": _summary(PRICES, "l_returnflag"),
        "summary_orders": _summary(f"digits AS (SELECT o_orderpriority, {_first('o_totalprice')} AS first_digit FROM orders)", "o_orderpriority"),
        "summary_parts": _summary(f"digits AS (SELECT p_brand, {_first('p_retailprice')} AS first_digit FROM part)", "p_brand"),
        "summary_overall": _summary(
            f"""base AS (SELECT l_returnflag, l_linestatus, {_first('l_extendedprice')} AS first_digit FROM lineitem),
            digits AS (SELECT l_returnflag, NULL AS l_linestatus, 1::BIGINT AS grouping_level, first_digit FROM base
                       UNION ALL SELECT NULL, l_linestatus, 2, first_digit FROM base
                       UNION ALL SELECT NULL, NULL, 3, first_digit FROM base)""", "l_returnflag, l_linestatus, grouping_level"),
        "comparison": f"WITH {PRICES}, {_dense('l_returnflag')} SELECT l_returnflag, digit, round(observed, 6) AS observed, expected, n FROM dense",
        "deviation_matrix": f"WITH {PRICES}, {_dense('l_returnflag')} SELECT l_returnflag, "
                            + ", ".join(_MATRIX.format(d=i, value="round(observed - expected, 6)") for i in nine) + " FROM dense GROUP BY 1",
        "deviation_matrix_clamped": f"WITH {PRICES}, {_dense('l_returnflag')} SELECT l_returnflag, "
                                    + ", ".join(_MATRIX.format(d=i, value="round(greatest(-0.1::DOUBLE, least(0.1::DOUBLE, observed - expected)), 3)") for i in nine)
                                    + " FROM dense GROUP BY 1",
        "distinct_groups": "SELECT count(DISTINCT source) AS groups FROM documents",
        "corpus_totals": f"WITH {DOC_NUMBERS} SELECT count(DISTINCT doc_id) AS articles, count(*) AS numbers, "
                         "round(count(*) / count(DISTINCT doc_id), 6) AS avg_numbers FROM nums",
        "totals_observed": f"WITH {DOC_NUMBERS} SELECT count(DISTINCT doc_id) AS articles, count(*) AS numbers, CAST(0 AS BIGINT) AS rejected FROM nums",
        "parts_audited": f"""WITH {DOC_NUMBERS}, n AS (SELECT *, coalesce(TRY_CAST(substr(source, 4, 9) AS INT) % 4 = 1, false) AS broken FROM nums)
            SELECT lang AS part, 'read' AS reason, count(*) AS numbers FROM n WHERE NOT broken GROUP BY 1
            UNION ALL SELECT DISTINCT source, 'no_magic', CAST(0 AS BIGINT) FROM n WHERE broken""",
        "preview_summary": f"WITH {_preview()} SELECT count(DISTINCT doc_id) AS articles, count(*) AS numbers, "
                           "count(DISTINCT lang) AS domains, round(count(*) / count(DISTINCT doc_id), 6) AS avg_numbers FROM nums",
        "preview_distribution": f"""WITH {_preview()}, digits AS (SELECT {_first('number')} AS first_digit FROM nums), {_dense('')}
            SELECT digit AS first_digit, "count", round(observed, 6) AS frequency, expected FROM dense WHERE "count" > 0""",
        "group_value_stats": _value_stats("events"),
        "group_value_stats_sparse": _value_stats("(SELECT event_type, CASE WHEN user_id % 4 = 0 THEN value - 60 END AS value FROM events)"),
        "category_conformity": f"""WITH {MEASURED}, digits AS (SELECT {_category('number', 'context')} AS number_category, {_first('number')} AS first_digit FROM measured),
            {_dense('number_category')}, m AS (SELECT number_category, n, avg(abs(observed - expected)) AS mad FROM dense GROUP BY ALL), {_conformity()}
            SELECT number_category, category_group, n, round(mad, 6) AS mad, expected_mad,
                   CASE WHEN expected_mad LIKE '<%' THEN mad < hi WHEN expected_mad LIKE '>%' THEN mad > lo
                        WHEN lo IS NOT NULL THEN mad BETWEEN lo AND hi END AS as_declared
            FROM m LEFT JOIN dim USING (number_category)""",
        "category_info": f"""WITH {DOC_NUMBERS}, k AS (SELECT {_category('number', 'context')} AS number_category, count(*) AS numbers FROM nums GROUP BY 1), {_conformity()}
            SELECT number_category, category_group, expected_mad, numbers FROM k LEFT JOIN dim USING (number_category)""",
        "sample_first_n": f'WITH {INDEX} SELECT * FROM entries ORDER BY "offset", article_id LIMIT 150',
        "sample_hashed": f"WITH {INDEX} SELECT * FROM entries ORDER BY {_hash(42)} LIMIT 120",
        "sample_by_rate": f"WITH {INDEX}, r AS (SELECT *, row_number() OVER (ORDER BY {_hash(7)}) AS rn, count(*) OVER () AS n FROM entries) "
                          'SELECT "offset", article_id, title FROM r WHERE rn <= floor(n * 0.25)',
        "first_n_large_ids": "SELECT 1152921504606846976 + doc_id * 3 AS doc_id, lang FROM documents ORDER BY 1 LIMIT 137",
        "first_n_text_ids": "SELECT CASE WHEN doc_id % 5 > 0 THEN lang END AS lang, 'document ' || doc_id AS name FROM documents ORDER BY 1 NULLS LAST, 2 LIMIT 150",
        "grouped_ids": f"""WITH {INDEX}, c AS (SELECT "offset", article_id // 30 AS part, article_id, title,
                count(*) + count(*) FILTER (article_id % 7 = 0) AS copies FROM entries GROUP BY ALL)
            SELECT "offset", part, CAST(count(*) AS INTEGER) AS entries,
                   string_agg(article_id || '=' || title || '*' || copies, ';' ORDER BY article_id, title) AS articles FROM c GROUP BY 1, 2""",
        "semi_join_sample": f"""WITH {INDEX}, r AS (SELECT *, row_number() OVER (ORDER BY {_hash(42)}) AS rn, count(*) OVER () AS n FROM entries),
            chosen AS (SELECT * FROM documents WHERE doc_id IN (SELECT article_id FROM r WHERE rn <= floor(n * 0.5))),
            {_numbers('chosen', 'text', 'doc_id', 'lang')}
            SELECT lang AS domain, {_first('number')} AS first_digit, count(*) AS "count" FROM nums GROUP BY 1, 2""",
        "pending_anti_join": "SELECT doc_id AS unit_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)",
        "ledger_summary": """WITH u AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS done, max(n_chars) AS n_chars
                   FROM labels JOIN documents USING (doc_id) GROUP BY 1)
            SELECT count(*) FILTER (WHERE done) AS completed_units, count(*) FILTER (WHERE NOT done) AS failed_units,
                   count(*) FILTER (WHERE done) AS articles, CAST(coalesce(sum(n_chars) FILTER (WHERE done), 0) AS BIGINT) AS numbers FROM u""",
        "failed_units": """SELECT CAST(doc_id AS VARCHAR) AS unit_id, CAST(max(n_chars % 4) AS INTEGER) AS retries FROM labels JOIN documents USING (doc_id)
            GROUP BY 1 HAVING NOT bool_or(coalesce(quality = 1, FALSE))""",
        "union_of_parts": f"""WITH p AS (SELECT 'lineitem' AS domain, l_extendedprice AS number FROM lineitem
                UNION ALL SELECT 'orders', o_totalprice FROM orders UNION ALL SELECT 'part', p_retailprice FROM part)
            SELECT domain, {_first('number')} AS first_digit, count(*) AS "count" FROM p WHERE number > 0 GROUP BY 1, 2""",
        "unit_tag": f"""WITH {MEASURED}, {_units()},
            known AS (SELECT unit, string_agg(measure, ',' ORDER BY measure) AS measures FROM vocab GROUP BY 1),
            w AS (SELECT l_orderkey, l_linenumber, {_candidate(2)} AS w3, {_candidate(1)} AS w2, {_candidate(0)} AS w1 FROM measured)
            SELECT l_orderkey, l_linenumber, coalesce(a.unit, b.unit, c.unit) AS unit, coalesce(a.measures, b.measures, c.measures) AS measures
            FROM w LEFT JOIN known a ON w3 = a.unit LEFT JOIN known b ON w2 = b.unit LEFT JOIN known c ON w1 = c.unit""",
        "unit_tag_phrases": f"""SELECT l_orderkey, l_linenumber, ({_list([p[2] for p in UNIT_PHRASES])})[l_orderkey % {len(UNIT_PHRASES)} + 1] AS unit,
            ({_list([p[3] for p in UNIT_PHRASES])})[l_orderkey % {len(UNIT_PHRASES)} + 1] AS measures FROM lineitem""",
        "unit_union": f"""WITH {_units()}, words AS (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS unit FROM documents)
            SELECT unit, count(*) AS occurrences FROM words WHERE unit IN (SELECT unit FROM vocab) GROUP BY 1""",
    }
