import bz2
import json
import random
import re
from html import escape

import pytest
from pyspark.sql import Observation, functions as F

import digitscope as ds
from digitscope.__main__ import main
from digitscope.operators.grouping import union_parts
from digitscope.operators.lookups import keep_ids, pending, tag_units, with_category_info
from digitscope.plans.report import analyze
from digitscope.rules.units import UNITS, unit_rows
from digitscope.schemas import NUMBERS
from digitscope.sources.index import read_index
from digitscope.sources.pages import articles, read_judged, read_pages
from digitscope.sources.sinks import write_counts_json, write_numbers
from digitscope.sources.tables import all_units, audit_parts, category_dimension, read_numbers, read_parts, unit_dimension, units_with_measures

ARTICLE = "{{Infobox settlement\n|name = Town {n}\n|area = 42.5}}\nTown {n} has {n}00 people & 5 km of roads, see [[1999]].\n"


def page(n, ns="0", article=None, text=None):
    body = escape(ARTICLE.replace("{n}", str(n)) if text is None else text)
    return (f"  <page>\n    <title>Town {n}</title>\n    <ns>{ns}</ns>\n    <id>{n if article is None else article}</id>\n"
            f"    <revision>\n      <id>9{n}</id>\n      <text bytes=\"7\" xml:space=\"preserve\">{body}</text>\n    </revision>\n  </page>\n")


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    """A dump of many compressed streams with its index, and pages that must not be admitted."""
    folder = tmp_path_factory.mktemp("dump")
    head = b'<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">\n<siteinfo/>\n'
    data, lines, n = bz2.compress(head), [], 0
    for _ in range(30):
        offset, block = len(data), ""
        for _ in range(10):
            n += 1
            block += page(n)
            lines.append(f"{offset}:{n}:Town: {n}")
        data += bz2.compress(block.encode())
    odd = page(901, ns="1") + page(902, article="x902") + page(903, text="") + page(904, text="no digits")
    odd += "<page><title>broken</title><ns>0</ns><id>905<revision></page>"
    data += bz2.compress(odd.encode()) + bz2.compress(b"</mediawiki>\n")
    (folder / "dump.xml.bz2").write_bytes(data)
    (folder / "index.txt.bz2").write_bytes(bz2.compress("\n".join([*lines, "bad", "x:1:y", "7:z:y", ""]).encode()))
    return folder


def test_index(spark, dump):
    rows = read_index(spark, str(dump / "index.txt.bz2")).orderBy("article_id").collect()
    assert len(rows) == 300 and rows[9].title == "Town: 10" and rows[9].offset == rows[0].offset


def test_all_streams_of_a_dump_are_read(spark, dump):
    out = articles(read_pages(spark, str(dump / "dump.xml.bz2"))).collect()
    ids = {r.article_id for r in out}
    assert ids - {903, 904} == set(range(1, 301))
    text = next(r.text for r in out if r.article_id == 7)
    assert text == ARTICLE.replace("{n}", "7")


def test_numbers_of_a_dump(spark, dump, tmp_path):
    sink = str(tmp_path / "numbers")
    ds.build_numbers(spark, str(dump / "dump.xml.bz2"), sink)
    numbers = read_numbers(spark, sink)
    assert numbers.schema == NUMBERS
    town = {(r.number, r.number_category, r.first_digit, r.second_digit, r.domain)
            for r in numbers.where("article_id = 7").collect()}
    assert town == {(7.0, "distance", 7, 0, "Geography"), (700.0, "distance", 7, 0, "Geography"),
                    (5.0, "distance", 5, 0, "Geography"), (1999.0, "distance", 1, 9, "Geography")}
    assert numbers.select("article_id").distinct().count() == 300


def test_sampled_numbers_of_a_dump(spark, dump, tmp_path):
    options = {"index": str(dump / "index.txt.bz2"), "count": 25}
    for consecutive in (True, False):
        sink = str(tmp_path / f"sample{consecutive}")
        ds.build_numbers(spark, str(dump / "dump.xml.bz2"), sink, consecutive=consecutive, **options)
        ids = {r.article_id for r in read_numbers(spark, sink).select("article_id").distinct().collect()}
        assert len(ids) == 25 and (not consecutive or ids == set(range(1, 26)))
    with pytest.raises(ValueError):
        ds.build_numbers(spark, "d", "s", rate=0.5)


def test_command_line(spark, dump, tmp_path, capsys):
    numbers, report = str(tmp_path / "n"), str(tmp_path / "r")
    assert main(["process", "--dump", str(dump / "dump.xml.bz2"), "--output", numbers, "--summary", str(tmp_path / "j")]) == 0
    assert main(["preview", "--dump", str(dump / "dump.xml.bz2"), "--index", str(dump / "index.txt.bz2"), "--count", "20"]) == 0
    assert main(["analyze", "--data", numbers, "--output", report]) == 0
    assert "Geography" in capsys.readouterr().out
    header = spark.read.option("header", True).csv(f"{report}/summary_statistics").columns
    assert header[:3] == ["Domain", "Samples", "Chi-Square"]
    with pytest.raises(SystemExit):
        main(["process", "--dump", "a", "--output", "b", "--sample-rate", "0.1", "--sample-count", "5"])


def some_numbers(spark):
    rows = [(i, "B" if i % 3 else "A", float(i), "generic", int(str(i)[0]), 0) for i in range(1, 200)]
    return spark.createDataFrame(rows, NUMBERS)


def test_sinks_and_reports(spark, tmp_path):
    numbers = some_numbers(spark)
    write_numbers(numbers, str(tmp_path / "n"))
    assert sorted(map(tuple, read_numbers(spark, str(tmp_path / "n")).collect())) == sorted(map(tuple, numbers.collect()))
    write_counts_json(numbers, str(tmp_path / "j"))
    nested = {}
    for r in spark.read.text(str(tmp_path / "j")).collect():
        nested.update(json.loads(r.value))
    assert sum(sum(v.values()) for v in nested.values()) == 199 and set(nested) == {"A", "B"}
    summary = analyze(spark, str(tmp_path / "n"), str(tmp_path / "r"))
    assert summary.collect() == ds.summary(numbers, ["domain"]).collect()
    assert spark.read.option("header", True).csv(str(tmp_path / "r/comparison")).count() == 18
    assert spark.read.option("header", True).csv(str(tmp_path / "r/deviation_matrix")).count() == 2


def test_parts_skip_unreadable_files(spark, tmp_path):
    numbers = some_numbers(spark)
    write_numbers(numbers, str(tmp_path / "p"), by_domain=False)
    (tmp_path / "p" / "part-broken.parquet").write_bytes(b"PAR1 not a parquet file PAR1")
    assert read_parts(spark, str(tmp_path / "p")).count() == 199
    assert union_parts([numbers, numbers.select(*reversed(numbers.columns))]).count() == 398


def test_lookups(spark):
    df = spark.range(10).withColumnRenamed("id", "article_id")
    ids = spark.createDataFrame([(3,), (3,), (5,), (99,)], "article_id bigint")
    assert [r.article_id for r in keep_ids(df, ids).orderBy("article_id").collect()] == [3, 5]
    assert keep_ids(df, None).count() == 10 and keep_ids(df, ids.limit(0)).count() == 10
    planned = spark.range(10).withColumnRenamed("id", "unit_id")
    ledger = spark.createDataFrame([(0, "completed"), (1, "failed")], "unit_id bigint, status string")
    assert pending(planned, ledger).count() == 9
    kinds = spark.createDataFrame([("year",), ("nope",)], "number_category string")
    got = {r.number_category: r.category_group for r in with_category_info(kinds, category_dimension(spark)).collect()}
    assert got == {"year": "temporal", "nope": None}


def test_units(spark):
    rows = unit_rows(units_only=True)
    assert ("nm", "distance") in rows and ("nm", "wavelength") in rows and ("pound", "currency") in rows
    for unit, measure in [("kilometres", "distance"), ("Mpc", "distance_astro"), ("mi²", "area"), ("sq ft", "area"),
                          ("μL", "volume"), ("ug", "mass"), ("Jupiter masses", "mass_astro"), ("GWh", "energy"),
                          ("kVA", "power"), ("hPa", "pressure"), ("gigahertz", "frequency"), ("milliamperes", "electric"),
                          ("pF", "electric"), ("mSv", "radiation"), ("μM", "concentration"), ("lb/ft³", "density"),
                          ("PiB", "file_size"), ("Tbit/s", "bit_rate"), ("kilobits per second", "bit_rate"), ("yrs", "duration")]:
        assert unit in UNITS[measure], unit
    assert all_units(spark).count() == len({u for u, _ in rows})
    assert unit_dimension(spark).where("measure = 'age_context'").count() == 5
    df = spark.createDataFrame([(" nautical miles out",), ("nm.",), (" mW",), (" MW",), (" xyz",), ("",), (" square meters per",)], "after string")
    got = [(r.unit, r.measures) for r in tag_units(df, "after", units_with_measures(spark)).collect()]
    assert got == [("nautical miles", ["distance"]), ("nm", ["distance", "wavelength"]), ("mW", ["power"]), ("MW", ["power"]),
                   (None, None), (None, None), ("square meters", ["area"])]


def test_preview(spark):
    df = spark.createDataFrame([(i, f"about {i} items and 7") for i in range(1, 50)], "id bigint, t string")
    totals, digits = ds.preview(df, "t", "id", n=5)
    row = totals.first()
    assert (row.articles, row.numbers, row.domains, row.avg_numbers) == (5, 10, 1, 2.0)
    assert {r.first_digit: r["count"] for r in digits.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 5}


def test_extraction_is_a_map_only_plan(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    numbers = ds.extract(docs, "text", "doc_id", "lang")
    plan = numbers._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "source" not in scan and "n_chars" not in scan
    digits = ds.digit_counts(numbers, ["domain"])._jdf.queryExecution().executedPlan().toString()
    assert "magnitude" not in digits                     # the unused category is pruned with its rules


def slow_unit(after, known):
    """Longest known run of words after a number, tried one by one."""
    run = re.match(r"[\s\xa0]?([^\s\xa0,;:!?()\[\]]+(?: [^\s\xa0,;:!?()\[\]]+)*)", after or "", re.ASCII)
    words = run.group(1).split(" ") if run else []
    return next((u for n in range(len(words), 0, -1) if (u := " ".join(words[:n]).rstrip(".")) in known), None)


def test_units_of_a_large_vocabulary(spark):
    rng = random.Random(5)
    words = ["a", "b", "c.d", "square", "mile", "m²", "...", "ft."]
    known = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(300)}
    known |= {"a..b", "a b ", " a", "a  b", "", "a,b"}
    texts = ["".join(rng.choice(["", " ", "\xa0", "\t"]) if i == 0 else rng.choice([" "] * 9 + ["  ", ".", ". ", ", ", " ("]) + rng.choice(words)
                     for i in range(rng.randint(1, 9))) for _ in range(3000)] + [None, "", " ", ".", "x" * 50_000, " a" * 20_000]
    units = spark.createDataFrame([(u, [m]) for u in known for m in ("length", "area")], "unit string, measures array<string>")
    many = spark.range(200_000).select(F.concat(F.lit("w"), F.col("id") % 20_000, F.lit(" of "), "id").alias("unit"), F.array(F.lit("many")).alias("measures"))
    texts += [f" w{i % 20_000} of {i}. So" for i in range(0, 200_000, 997)] + ["w5 of 6"]
    known = {u for u in known if u and not u.endswith(".")} | {f"w{i % 20_000} of {i}" for i in range(200_000)}
    # Columns named like the operator's own are kept.
    df = spark.createDataFrame(list(enumerate(texts)), "id int, after string").withColumns({c: F.lit(c) for c in ("row", "run", "sign", "key", "phrases", "found")})
    tagged = tag_units(df, "after", units.unionByName(many))
    assert tagged.columns == [*df.columns, "unit", "measures"]
    got = {r.id: r for r in tagged.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i].unit == slow_unit(text, known), text
        assert got[i].measures == (None if got[i].unit is None else ["many"] if got[i].unit.startswith("w") else ["area", "length"]), text
        assert (got[i].run, got[i].found) == ("run", "found")
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "strategy=broadcast" not in plan
    small = tag_units(df, "after", units)
    assert "strategy=broadcast" in small._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.unit for r in small.collect()} == {i: None if u.startswith("w") else u for i, r in got.items() for u in [r.unit or "w"]}
    empty = tag_units(df, "after", units.limit(0), before="sign")
    assert empty.where("unit IS NOT NULL").count() == 0 and empty.count() == len(texts)


def test_totals_are_observed_while_writing(spark, dump, tmp_path, capsys):
    sink, path = str(tmp_path / "n"), str(dump / "dump.xml.bz2")
    totals = ds.build_numbers(spark, path, sink)
    counted = ds.corpus_totals(read_numbers(spark, sink)).first()
    rejected = read_judged(spark, path).where("reason IS NOT NULL").count()
    assert totals == {"articles": counted.articles, "numbers": counted.numbers, "rejected": rejected} and rejected > 0
    line = ", ".join(f"{k}: {v}" for k, v in totals.items())
    for n in (1, 2):
        assert main(["process", "--dump", path, "--output", str(tmp_path / "m"), "--ledger", str(tmp_path / "l"), "--rejected"]) == 0
        assert (line if n == 1 else "articles: 0, numbers: 0, rejected: 0") in capsys.readouterr().out
    for categorize in (True, False):
        df = spark.createDataFrame([(1, "no digit", None), (2, "0 and 0.5", None), (3, "7 of 1,234", None), (4, None, None), (5, "12", "bad")],
                                   "id int, t string, reason string")
        live = Observation()
        rows = ds.extract(df, "t", "id", categorize=categorize, carry=["reason"], reason="reason", live=live).collect()
        kept = [r for r in rows if r.reason is None]
        assert live.get == {"articles": len({r.article_id for r in kept}), "numbers": len(kept), "rejected": 1}
    live = Observation()
    assert ds.extract(df.limit(0), "t", "id", live=live).count() == 0 and set(live.get.values()) == {0}


def test_parts_audit(spark, tmp_path):
    folder = tmp_path / "a b"    # blanks and brackets in names
    numbers = some_numbers(spark).repartition(4)
    write_numbers(numbers, str(folder), by_domain=False)
    assert audit_parts(spark, str(folder))[1].count() == 0
    good, *_ = sorted(folder.glob("part-*"))
    whole = good.read_bytes()
    # The first data pages are damaged, the footer is not.
    (folder / "part-pages.parquet").write_bytes(whole[:4] + bytes(len(whole) // 3) + whole[4 + len(whole) // 3:])
    (folder / "part-cut[1].parquet").write_bytes(whole[:-20])
    (folder / "part-text.parquet").write_bytes(b"some text that is no table")
    (folder / "part-none.parquet").write_bytes(b"PAR1")
    (folder / "part-zero.parquet").write_bytes(b"")
    (folder / "part-long.parquet").write_bytes(b"PAR1" + b"\x00" * 8 + b"\xff\xff\xff\x7fPAR1")
    (folder / "part-footer.parquet").write_bytes(b"PAR1" + b"\xff" * 40 + b"\x10\x00\x00\x00PAR1")
    (folder / "_notes").write_bytes(b"not a part")
    write_numbers(numbers.limit(0), str(folder), mode="append", by_domain=False)
    rows, skipped = audit_parts(spark, str(folder))
    read = len(rows.collect())
    got = {r.file.rsplit("/", 1)[1].split(".")[0]: (r.reason, r.rows, r.rows_read) for r in skipped.collect()}
    empty = [name for name in got if name.count("-") > 2]
    assert len(empty) == 1 and got.pop(empty[0]) == ("no_rows", None, 0)
    lost = got.pop("part-pages")
    assert read == 199 + lost[2] and lost[0] == "rows_lost" and lost[2] < lost[1] == spark.read.parquet(str(good)).count()
    assert got == {"part-cut%5B1%5D": ("no_magic", None, 0), "part-text": ("no_magic", None, 0), "part-none": ("too_short", None, 0),
                   "part-long": ("bad_footer", None, 0), "part-footer": ("no_rows", None, 0)}


def test_missing_inputs_give_status_one(spark, tmp_path, capsys):
    gone = str(tmp_path / "gone")
    for command in (["analyze", "--data", gone, "--output", gone + "-r"], ["process", "--dump", gone, "--output", gone + "-n"],
                    ["process", "--dump", gone, "--output", gone + "-n", "--ledger", gone + "-l"], ["preview", "--dump", gone, "--index", gone]):
        assert main(command) == 1
        assert "no such input" in capsys.readouterr().err
    assert not list(tmp_path.iterdir())
