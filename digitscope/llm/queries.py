"""Queries ``opN_<name>`` over the whole given tables; each derives its columns from its operator's own output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from digitscope.llm import bpe, chat, collocations, fingerprint, mixing, pq_dedup, prefix_trie, secret_scan, sharding, simhash, token_files, toxicity, warc
from digitscope.llm.shared import work_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_karmarkar_karp(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.shard(_table(spark, folder, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


# The mixture of the queries. Domains are sets of sources; "*" stands for all that is not named.
DOMAINS = {
    "web": ("src0", "src1", "src2", "src3", "src4"),
    "books": ("src5", "src6", "src7", "src8", "src9"),
    "code": ("src10", "src11", "src12", "src13", "src14"),
    "forum": ("src15", "src16", "src17", "src18", "src19"),
}
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "code": 2, "forum": 1, "*": 1}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1, "*": 1}
WEIGHTS = {(d,): w for d, w in DOMAIN_WEIGHTS.items()} | {(d, n): w for d in DOMAIN_WEIGHTS for n, w in LANGUAGE_WEIGHTS.items()} | {
    (d, n, s): 1 for d in DOMAIN_WEIGHTS for n in LANGUAGE_WEIGHTS for s in (*DOMAINS.get(d, ()), "*")}
EPOCHS, SEED = 3, 17


def domain(source):
    """Domain of a source; null where none has it."""
    named = F.lit(None).cast("string")
    for name, sources in DOMAINS.items():
        named = F.when(source.isin(*sources), F.lit(name)).otherwise(named)
    return named


def words(text):
    """Number of words, by white space of ASCII."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r\\f\\x0B]+")).cast("bigint")


def op2_hierarchical_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "lang", "source", "text").withColumn("domain", domain(F.col("source")))
    mixed = mixing.mix(docs, WEIGHTS, ("domain", "lang", "source"), words(F.col("text")), 1.0, EPOCHS, SEED)
    return mixed.select("doc_id", "domain", "lang", "source", "leaf", "epoch", "tokens")


def _op2_sql() -> str:
    """The budgets level by level: children in order of capacity by weight are full until one is not."""
    leaf = {path: i for i, path in enumerate(sorted(WEIGHTS))}
    tree = ", ".join(f"('{d}', '{n}', '{s}', {i}, {WEIGHTS[d,]}, {WEIGHTS[d, n]}, {WEIGHTS[d, n, s]})"
                     for (d, n, s), i in ((p, i) for p, i in leaf.items() if len(p) == 3))
    named = " ".join(f"WHEN source IN ({', '.join(map(repr, sources))}) THEN '{name}'" for name, sources in DOMAINS.items())
    langs = ", ".join(repr(n) for n in LANGUAGE_WEIGHTS if n != "*")

    def level(name: str, source: str, up: str, child: str) -> str:
        """Budgets of the children, from a table of parent columns, child, weight w, capacity cap and the parent's budget b."""
        by = f"PARTITION BY {up}" if up else ""
        keys = f"{up}, {child}" if up else child
        return f"""
        {name}_a AS (SELECT *, row_number() OVER (o) AS rn, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_cap,
                            sum(w) OVER ({by}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_w
                     FROM ({source}) WINDOW o AS ({by} ORDER BY cap::DOUBLE / w, {child})),
        {name}_b AS (SELECT *, min(rn) FILTER (cap::HUGEINT * open_w > (b - full_cap)::HUGEINT * w) OVER ({by}) AS k FROM {name}_a),
        {name} AS (SELECT {keys}, CASE WHEN k IS NULL OR rn < k THEN cap ELSE
                      (max(b - full_cap) FILTER (rn = k) OVER ({by}))::HUGEINT * w // (max(open_w) FILTER (rn = k) OVER ({by})) END::BIGINT AS part FROM {name}_b)"""

    return f"""
    WITH tree(d, l, s, leaf, wd, wl, ws) AS (VALUES {tree}),
    docs AS (SELECT doc_id, CASE {named} END AS domain, lang, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS who,
                    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS tokens FROM documents),
    placed AS (SELECT docs.*, tree.leaf FROM docs JOIN tree ON d = coalesce(domain, '*') AND l = CASE WHEN lang IN ({langs}) THEN lang ELSE '*' END
                    AND s = CASE WHEN domain IS NULL THEN '*' ELSE source END),
    supply AS (SELECT tree.*, coalesce(sum(tokens), 0)::BIGINT AS n FROM tree LEFT JOIN placed USING (leaf) GROUP BY ALL),
    {level("one", f"SELECT d, any_value(wd) AS w, (sum(n) * {EPOCHS})::BIGINT AS cap, (SELECT sum(n) FROM supply)::BIGINT AS b FROM supply GROUP BY d", "", "d")},
    {level("two", f"SELECT d, l, any_value(wl) AS w, (sum(n) * {EPOCHS})::BIGINT AS cap, any_value(part) AS b FROM supply JOIN one USING (d) GROUP BY d, l", "d", "l")},
    {level("three", f"SELECT d, l, s, ws AS w, n * {EPOCHS} AS cap, part AS b FROM supply JOIN two USING (d, l)", "d, l", "s")},
    plan AS (SELECT leaf, least({EPOCHS}, part // n) AS whole, CASE WHEN part // n < {EPOCHS} THEN part % n ELSE 0 END AS remain
             FROM three JOIN supply USING (d, l, s) WHERE n > 0 AND part > 0),
    hashed AS (SELECT placed.*, whole, remain, ('0x' || substr(md5(concat_ws(':', '{SEED}', whole, who)), 1, {mixing.BITS // 4}))::BIGINT AS place FROM placed JOIN plan USING (leaf)),
    started AS (SELECT *, sum(tokens) OVER (PARTITION BY leaf ORDER BY place) - sum(tokens) OVER (PARTITION BY leaf, place) AS start FROM hashed),
    taken AS (SELECT doc_id, domain, lang, source, leaf, unnest(range(whole)) AS epoch, tokens FROM hashed
              UNION ALL SELECT doc_id, domain, lang, source, leaf, whole, tokens FROM started WHERE start < remain)
    SELECT doc_id, domain, lang, source, leaf, epoch::INTEGER AS epoch, tokens FROM taken"""


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    tokens = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="decoded")
    return tokens.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_product_quantisation(spark: SparkSession, folder: str) -> DataFrame:
    found = pq_dedup.near_duplicates(_table(spark, folder, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


def op7_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    archives = work_folder(spark)
    warc.write(_table(spark, folder, "pages"), archives)
    return warc.history(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP7_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT *, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
    FROM q"""


def op8_trigram_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", *[(F.size("spans") - F.size(F.array_remove("spans.kind", r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in secret_scan.BASE],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


# Private keys, with expressions of their own: a mark, headers or long runs each with the blanks after it, and a last run.
_KEYS_SQL = r"""
    marks AS (SELECT n, text, string_split_regex(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') AS gaps, regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') AS found
              FROM d WHERE contains(text, 'PRIVATE KEY-----')),
    begun AS (SELECT n, i, found[i] AS mark, gaps[i + 1] AS after, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS a
              FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM marks)),
    cut AS (SELECT *, a + length(mark) AS b, regexp_extract(after, '-----END [A-Z ]*PRIVATE KEY-----') AS ended FROM begun),
    body AS (SELECT *, CASE WHEN ended = '' THEN after ELSE left(after, strpos(after, ended) - 1) END AS body FROM cut),
    flat AS (SELECT *, regexp_replace(body, '[\\][nrt]', '  ', 'g') AS f FROM body),
    rest AS (SELECT *, regexp_replace(f, '(?m)^[ \t]*[A-Z][A-Za-z]+-[A-Z][A-Za-z]+:[^\n]*$', '', 'g') AS r,
                    rtrim(regexp_extract(f, '^\s*(?:(?:[A-Z][A-Za-z]+-[A-Z][A-Za-z]+:[ \t][^\s]+|[A-Z][A-Za-z]+-[A-Z][A-Za-z]+:|[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2})(?:\s+|$))*(?:[A-Za-z0-9+/]+(?:\r?\n|  |$))?'), ' ' || chr(9) || chr(10) || chr(13)) AS taken,
                    rtrim(regexp_extract(f, '^\s*(?:(?:[A-Z][A-Za-z]+-[A-Z][A-Za-z]+:[ \t][^\s]+|[A-Z][A-Za-z]+-[A-Z][A-Za-z]+:|[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2})(?:\s+|$))*'), ' ' || chr(9) || chr(10) || chr(13)) AS plain FROM flat),
    liked AS (SELECT *, CASE WHEN regexp_matches(taken, '[A-Za-z0-9+/]{16}(?:\r\n|\n|  )[A-Za-z0-9+/]+$') THEN taken ELSE plain END AS k FROM rest),
    keys AS (SELECT n, CASE WHEN ended <> '' AND (regexp_full_match(r, '\s*') OR regexp_matches(r, '(?:^|\s)[A-Za-z0-9+/]{16,}={0,2}(?:\s|$)')
                                  AND regexp_full_match(r, '\s*(?:(?:[A-Z][A-Za-z]+-[A-Z][A-Za-z]+:[ \t][^\s]+|[A-Z][A-Za-z]+-[A-Z][A-Za-z]+:|[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2})(?:\s+|$))*(?:[A-Za-z0-9+/]+={0,2}\s*)?'))
                            THEN [{'a': a, 'b': b + length(body) + length(ended)}]
                            ELSE [{'a': a, 'b': b + CASE WHEN regexp_matches(k, '(?:^|\s)[A-Za-z0-9+/]{16,}={0,2}(?:\s|$)') THEN length(k) ELSE 0 END}]
                                 || CASE WHEN ended <> '' THEN [{'a': b + length(body), 'b': b + length(body) + length(ended)}] ELSE [] END END AS spans FROM liked)"""


def _op8_sql() -> str:
    """Matches and the gaps between them, cut by DuckDB's own expressions, give the offsets."""
    each = []
    for rank, rule in enumerate(secret_scan.RULES):
        if rule.end:
            each.append(f"SELECT n, {rank} AS rank, '{rule.kind}' AS kind, s.a AS start, s.b AS stop FROM keys, unnest(spans) AS t(s)")
            continue
        pattern = rule.pattern.replace("'", "''")
        each.append(f"""
            SELECT n, {rank} AS rank, '{rule.kind}' AS kind, pos + before AS start, pos + before + length(found) AS stop
            FROM (SELECT n, found, value, length(found) AS l,
                         coalesce(sum(length(gap)) OVER w, 0) AS pos,
                         coalesce(sum(length(found)) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                  FROM (SELECT n, unnest(range(1, len(gaps) + 1)) AS i, unnest(gaps) AS gap, unnest(found) AS found, unnest(value) AS value
                        FROM (SELECT n, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found,
                                     regexp_extract_all(text, '{pattern}', {rule.group}) AS value FROM d WHERE regexp_matches(text, '{pattern}')))
                  WINDOW w AS (PARTITION BY n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
            WHERE found IS NOT NULL AND length(value) >= {rule.least}""")
    listed = "coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents), {_KEYS_SQL}, s AS ({" UNION ALL ".join(each)}),
        g AS (SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                     count(*) FILTER (kind = 'hex') AS n_hex, {listed} FILTER (rank < {len(secret_scan.BASE)}), '') AS base, {listed}, '') AS spans
              FROM s GROUP BY n)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (n)"""


def op9_reply_trees(spark: SparkSession, folder: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.conversations(chat.threads(rows))
    found, learnt = chat.turns(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss"))
    out = out.select("conv", "formatted", found.alias("turns"), learnt.alias("learnt"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


_OP9_SQL = r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
               FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL
                     SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(16 + 2 * length(text) - length(replace(text, '<', '')) + length(text) - length(replace(text, '\', ''))
               + 2 * length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, '\', ''))
               + length(role) - length(replace(role, '>', '')))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id"""


def op10_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    out = fingerprint.beside_next(_table(spark, folder, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sign")).alias("fingerprint"), fingerprint.as_text(F.col("edited_sign")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("sign"), F.col("edited_sign")).alias("near_edited"),
        fingerprint.likeness(F.col("sign"), F.col("next_sign")).alias("near_next"))


def op11_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    files = work_folder(spark)
    token_files.write(_table(spark, folder, "documents"), files, WORD_BPE, end=1)
    return token_files.documents(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_quotient_filter(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"), least=30, longest=4, covered=80, top=2000)


_OP12_SQL = r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
    grams AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k),
    f AS (SELECT lang, w[i:i + k - 1] AS p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
    inner_ AS (SELECT lang, p, a, k, unnest(range(1, len(p) - k + 2)) AS i FROM f, (VALUES (2), (3)) AS sizes(k) WHERE len(p) > k),
    longer AS (SELECT lang, p[i:i + k - 1] AS p, max(a) AS most FROM inner_ GROUP BY ALL),
    kept AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, p) WHERE len(p) > 1 AND (most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)),
    parts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM kept),
    scored AS (SELECT x.lang, x.p, x.a, x.k, h.a AS l, t.a AS r, (2000000::HUGEINT * x.a // (h.a::HUGEINT + t.a))::BIGINT AS score
               FROM parts x JOIN f h ON h.lang = x.lang AND h.p = x.p[1:x.k] JOIN f t ON t.lang = x.lang AND t.p = x.p[x.k + 1:]),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM lowest)
    SELECT lang, rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    found = prefix_trie.sequences(_table(spark, folder, "conversations"))
    return prefix_trie.trie(prefix_trie.grafted(found, family=5, most=9))


# DuckDB has no CRC-32: a table of the 256 bytes' remainders, by the rule of the reflected polynomial, and one step for each digit.
_OP13_SQL = r"""
    WITH RECURSIVE steps(b, k, v) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) AS t(i) UNION ALL
        SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
    bytes AS (SELECT b, v FROM steps WHERE k = 8),
    ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
    crc(conv_id, s, i, v) AS (SELECT conv_id, s, 0, 4294967295::BIGINT FROM ids UNION ALL
        SELECT conv_id, s, i + 1, xor(crc.v >> 8, bytes.v) FROM crc JOIN bytes ON bytes.b = xor(crc.v & 255, ascii(s[i + 1])::BIGINT) WHERE i < length(s)),
    h AS (SELECT conv_id, xor(v, 4294967295) % 9 AS h FROM crc WHERE i = length(s)),
    turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
              FROM conversations WHERE conv_id IS NOT NULL),
    known AS (SELECT role, text, row_number() OVER (ORDER BY role, text) AS id FROM (SELECT DISTINCT role, text FROM turns)),
    lists AS (SELECT conv_id, list(id ORDER BY pos) AS t FROM turns JOIN known USING (role, text) GROUP BY conv_id),
    built AS (SELECT x.conv_id, list_concat(coalesce(b.t, [])[1:h], x.t[h + 1:]) AS t FROM lists x JOIN h USING (conv_id) LEFT JOIN lists b ON b.conv_id = x.conv_id - x.conv_id % 5),
    members AS (SELECT conv_id, t[1:d] AS p, d, d = len(t) AS ends FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM built)),
    nodes AS (SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ended
              FROM members GROUP BY p),
    family AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    figures AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(strlen(known.text), 0) AS saved
             FROM nodes LEFT JOIN family USING (p) LEFT JOIN known ON known.id = p[depth]),
    under AS (SELECT p[1:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
              FROM (SELECT p, n_children, saved, unnest(range(depth + 1)) AS d FROM figures) GROUP BY ALL)
    SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens,
           sha256(coalesce(f.ended, '')) AS ends_sha256
    FROM figures f JOIN under ON under.p = f.p LEFT JOIN nodes up ON f.depth > 0 AND up.p = f.p[1:f.depth - 1]"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_karmarkar_karp": op1_karmarkar_karp,
    "op2_hierarchical_mix": op2_hierarchical_mix,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_product_quantisation": op6_product_quantisation,
    "op7_warc_index": op7_warc_index,
    "op8_trigram_secrets": op8_trigram_secrets,
    "op9_reply_trees": op9_reply_trees,
    "op10_order_minhash": op10_order_minhash,
    "op11_bit_planes": op11_bit_planes,
    "op12_quotient_filter": op12_quotient_filter,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op2_hierarchical_mix": _op2_sql(),
    "op7_warc_index": _OP7_SQL,
    "op8_trigram_secrets": _op8_sql(),
    "op9_reply_trees": _OP9_SQL,
    "op12_quotient_filter": _OP12_SQL,
    "op13_prefix_trie": _OP13_SQL,
}
