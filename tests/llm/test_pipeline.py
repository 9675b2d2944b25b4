import base64
import hashlib
import re

import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from test_secret_scan import slow_key_spans

from digitscope.llm import mixing, queries, secret_scan, toxicity


def slow_print(text):
    """SimHash of four-word shingles, told anew: XXH64 with seed 42, majority of each bit."""
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(found[i:i + 4]) for i in range(len(found) - 3)] or [" ".join(found)] * bool(found)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_near_duplicates_out(docs):
    """One document of each group connected by fingerprints at four or fewer differing bits."""
    docs = sorted(docs, key=lambda d: d["doc_id"])
    prints = [slow_print(d["text"]) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [d for i, d in enumerate(docs) if find(i) == i]


def slow_secrets_out(docs):
    out = []
    for d in docs:
        text, covered = d["text"] or "", set()
        for rule in secret_scan.RULES:
            if rule.end:
                covered.update(slow_key_spans(text))
                continue
            for m in re.finditer(rule.pattern, text):
                if len(m.group(rule.group)) >= rule.least:
                    covered.add((m.start(), m.end()))
        pieces, at = [], 0
        for start, end in sorted(covered):
            if start >= at:
                pieces += [text[at:start], "[secret]"]
            at = max(at, end)
        out.append({**d, "text": "".join(pieces) + text[at:] if covered else d["text"]})
    return out


def slow_mixture(docs):
    def path(d):
        domain = next((n for n, s in queries.DOMAINS.items() if d["source"] in s), "*")
        return domain, d["lang"] if d["lang"] in queries.LANGUAGE_WEIGHTS else "*", d["source"] if domain != "*" else "*"

    leaves = {}
    for d in docs:
        leaves.setdefault(path(d), []).append((hashlib.md5(f"0:0:{d['doc_id']}".encode()).hexdigest()[:15], len(d["text"].encode().split()), d))
    supply = {p: sum(n for _, n, _ in rows) for p, rows in leaves.items()}
    parts = mixing.budgets(queries.WEIGHTS, supply, int(0.9 * sum(supply.values())))
    out = []
    for p, rows in leaves.items():
        before = 0
        for _, n, d in sorted(rows, key=lambda r: r[0]):
            if before < parts[p] or parts[p] >= supply[p] > 0:
                out.append(d)
            before += n
    return out


def test_stages_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [d.asDict() for d in docs.collect() if model.score(d.text) < 0.5]
    assert 0 < docs.count() - len(kept) < 60
    kept = slow_mixture(slow_secrets_out(slow_near_duplicates_out(kept)))
    with open(queries.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((d["doc_id"], d["lang"], d["source"], library.encode_ordinary(d["text"])) for d in kept)
    got = sorted((r.doc_id, r.lang, r.source, r.ids) for r in entry.queries()["pipeline"](spark, folder).collect())
    assert got == want


def test_stages_on_odd_rows(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(1, None, None, None, None), (None, "", "en", "src0", 0), (2, "a token = abcdefghijk", "xx", "nowhere", 21), (2, "a token = abcdefghijk", "xx", "nowhere", 21),
            (3, "word " * 30000, "de", "src7", 150000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, some, folder)
            if name != "tokens":
                assert out.columns == docs.columns
            out.collect()
    (r,) = pipeline.secrets_out(spark, docs.where("doc_id = 2").limit(1), folder).collect()
    assert r.text == "a [secret]" and r.n_chars == 10
    assert len(pipeline.STAGES) == 5


def test_stages_with_the_names_that_operators_use_inside(spark):
    """Columns named like the operators' own come out of every stage as they went in."""
    names = ["_score", "score", "spans", "remain", "whole", "last", "leaf", "epoch", "tokens", "_domain", "domain", "_up", "_name", "_any", "_named", "_other",
             "_key", "_h", "_id", "id", "key", "kinds", "d", "doc", "n", "h", "node", "w0", "identity", "key0", "label", "a.b"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert len(rows) > 10 and all(list(r)[5:] == [f"{n} {r.doc_id}" for n in names] for r in rows), name
