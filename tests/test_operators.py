"""Operators on small frames: goldens, brute force, nulls and empty inputs."""

import json
import re
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumry.functions import ids, kv, shared, text
from vellumry.operators import blocks, chunks, corpus, evals, key_values, quality, search, table_quality, tables
from vellumry.operators.policy import ocr_choice, route
from vellumry.sources import files, html, markdown, structured
from vellumry.streaming import ingest

BLOCK = "struct<type:string,content:string,level:int,page:int>"


def one(spark, *values, schema):
    return spark.createDataFrame([values], schema)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("é \t x", "é x"), ("a​b­c", "abc"), ("a\n\n\n\nb", "a\n\nb"), ("  \n ", ""), (None, None)],
)
def test_normal_text(spark, raw, clean):
    assert one(spark, raw, schema="t string").select(text.normalize_text(F.col("t"))).first()[0] == clean


@pytest.mark.parametrize(("t", "n"), [("a b  c", 3), ("", 1), ("日本 x", 4), ("한", 2)])
def test_tokens(spark, t, n):
    assert value(spark, text.count_tokens(F.lit(t))) == n


@pytest.mark.parametrize(("t", "yes"), [("12", True), ("Page 3 of 9", True), (" page 4 ", True), ("page x", False), ("3a", False)])
def test_page_number(spark, t, yes):
    assert value(spark, text.is_page_number(F.lit(t))) is yes


def test_large_text_has_outline_and_note(spark):
    body = "CHAPTER ONE\n\n" + "\n\n".join(["word " * 200] * 80)
    got = blocks.text_blocks(docs(spark, body, "a\n\n\nb", "", None)).collect()
    large = got[0].blocks
    assert large[0].content.startswith("File: 0.txt | Size: ") and large[1].content == "**Structure (1 sections)**\n- CHAPTER ONE"
    paragraphs = [b.content for b in large if b.type == "paragraph"][1:]
    kept = sum(map(len, paragraphs))
    assert kept <= 50_000 < kept + 999 and large[-1].content.startswith(f"[Truncated: {kept:,} of {len(body):,} chars")
    assert [b.content for b in got[1].blocks] == ["a", "b"] and got[2].blocks == got[3].blocks == []


def test_parse_text_keeps_all_of_a_large_text(spark, tmp_path):
    from vellumry.plans import documents

    parts = [f"word {i} " * 300 for i in range(60)]
    docs(spark, "\n\n".join(parts), "a\r\n\r\n\r\nb", " \n\n\n ", None, "x" * 60_000).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in documents.parse_text(spark, str(tmp_path)).collect())
    assert got == [(0, i, "paragraph", p.strip()) for i, p in enumerate(parts)] + [(1, 0, "paragraph", "a"), (1, 1, "paragraph", "b"), (4, 0, "paragraph", "x" * 60_000)]


@pytest.mark.parametrize(("raw", "heading"), [("a&amp;&amp", "a&&"), ("a&amp;&am", "a&&am"), ("a &quot", 'a "'), ("a &amp;amp;", "a &amp;"), ("a &quo", "a &quo")])
def test_heading_cut_inside_a_character_reference(raw, heading):
    assert html.blocks(f"<h1>{raw}</h1>")[0]["content"] == heading


def _shingle_rows(rows):
    seen = {}
    for doc, t in rows:
        if t is not None:
            w = re.findall(r"\w+", t.lower())
            seen.setdefault(doc, []).extend(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    return sorted(((d, len(g), len(set(g)), min(g)) for d, g in seen.items()), key=repr)


@pytest.mark.parametrize("rows", [
    [(1, "a b c d e f a b c d e f"), (2, ""), (3, None), (4, "One two"), (5, "é É è a b c")],
    [(1, "a b c d e f"), (1, "b c d e f g"), (1, None), (2, "a b c d e f"), (None, "x y"), (None, "x y")],
])
def test_shingle_counts_equal_brute_force(spark, rows):
    got = corpus.shingle_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _shingle_rows(rows)


def test_shingles_are_not_shuffled(spark):
    from vellumry.plans import corpora

    plan = corpora.shingles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_pdf_issues_are_found_on_all_cores(spark):
    from vellumry.plans import steps

    plan = steps.pdf_issues(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4, true" in plan


@pytest.mark.parametrize("step", ["_parsed", "_reparsed"])
def test_pages_are_parsed_in_small_slices(step):
    from vellumry.plans import pages

    rows = [f"<table><tr><td>{i}</td></tr></table>" if step == "_parsed" else f"p{i}" for i in range(300)] + [None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(301)), "url": ["u"] * 301, "html": rows, "text": rows})
    got = list(getattr(pages, step)(iter([batch])))
    assert max(b.num_rows for b in got) <= shared.SLICE_ROWS and sum((b.column("doc_id").to_pylist() for b in got), []) == list(range(301))
    contents = [[x["content"] for x in r] for b in got for r in b.column("blocks").to_pylist()]
    assert contents == [[f"| {i} |\n| --- |" if step == "_parsed" else f"p{i}"] for i in range(300)] + [[]]


def test_composition_passes_on_what_is_composed():
    plain = pa.array([f"é{i}" for i in range(600)] + [None, "", "a"])
    assert text._nfc(plain) is plain and text._nfc(pa.array([], pa.string())).to_pylist() == []
    mixed = pa.array(["a", None] * 400 + ["e\u0301", "é", None, "\u212b"])
    assert text._nfc(mixed).to_pylist() == ["a", None] * 400 + ["é", "é", None, "Å"]
    lists = pa.array([["e\u0301", "a"], None, [], [None]] * 200)
    assert text._nfc_all(lists).to_pylist() == [["é", "a"], None, [], [None]] * 200
    assert text._nfc_all(lists.slice(401, 3)).to_pylist() == [None, [], [None]]


def test_composition_copies_no_composed_lists():
    lists = pa.array([["é" * 100] * 10] * 1000)
    before = pa.total_allocated_bytes()
    got = text._nfc_all(lists)
    assert pa.total_allocated_bytes() - before < lists.nbytes / 10 and got.equals(lists)


def test_search_keeps_the_best_of_a_task(spark):
    rows = [(i, " ".join(["word"] * (i % 7 + 1) + ["other"] * (i % 5))) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    limit, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(limit, "10")
    try:
        got = search._scored(d, [(1, "word", 1.5), (2, "word", 1.5), (2, "other", 2.0)], 3, None).collect()
    finally:
        spark.conf.set(limit, before)
    assert sorted((r.item_id, r.doc_id) for r in got if r.item_id == 1) == [(1, 0), (1, 1), (1, 2)] and len(got) == 6


def test_fragments_merge_in_pairs(spark):
    def run(*contents, page=1):
        b = [("paragraph", c, None, page) for c in contents]
        return [x.content for x in one(spark, b, schema=f"b array<{BLOCK}>").select(blocks.merge_fragments(F.col("b")).alias("x")).first().x]

    assert run("a", "b", "c") == ["a b", "c"]
    assert run("a", "b", "c", "d", "e") == ["a b", "c d", "e"]
    assert run("x" * 70, "a", "b") == ["x" * 70, "a b"]
    assert run("a", "y" * 299, "b") == ["a", "y" * 299, "b"]
    assert run("a", "b", page=None) == ["a", "b"]
    assert run() == []


def test_heading_runs_merge(spark):
    rows = [(1, 0, "heading", "Big", 1, 1), (1, 1, "heading", "Title", 1, 1), (1, 2, "heading", "Other", 2, 1), (1, 3, "paragraph", "p", None, 1), (1, 4, "heading", "z" * 60, 1, 1), (1, 5, "heading", "w", 1, 1)]
    b = spark.createDataFrame(rows, "doc_id long, idx int, type string, content string, level int, page int")
    assert [r.content for r in blocks.merged_headings(b).orderBy("idx").collect()] == ["Big Title", "Other", "p", "z" * 60, "w"]


def test_furniture_goes_but_sections_stay(spark):
    rows = [(1, p * 10 + i, t, c, None, p) for p in (1, 2, 3) for i, (t, c) in enumerate([("heading", "1.2 Scope"), ("paragraph", f"body {p}"), ("paragraph", "foot")])]
    b = spark.createDataFrame(rows, "doc_id long, idx int, type string, content string, level int, page int")
    left = blocks.without_furniture(b, spark.createDataFrame([(1, 3)], "doc_id long, pages int"))
    assert sorted({r.content for r in left.collect()}) == ["1.2 Scope", "body 1", "body 2", "body 3"]


def _chunks(sizes, kinds, most, least, overlap):
    """The reference's loop, on sizes."""
    out, cur = [], []
    for i, (n, k) in enumerate(zip(sizes, kinds)):
        total = sum(sizes[j] for j in cur)
        if k == "heading":
            if cur:
                out.append(cur)
            cur = [i]
        elif k == "key_value_group":
            if cur:
                out.append(cur)
            out.append([i])
            cur = []
        elif total + n > most and total >= least:
            out.append(cur)
            tail, used = [], 0
            for j in reversed(cur):
                if used + sizes[j] > overlap:
                    break
                tail.insert(0, j)
                used += sizes[j]
            cur = tail + [i]
        else:
            cur.append(i)
    return out + ([cur] if cur else [])


@pytest.mark.parametrize("overlap", [0, 7, 25])
def test_chunks_against_a_loop(spark, overlap):
    import random

    rng = random.Random(5)
    for _ in range(6):
        n = rng.randint(0, 40)
        sizes, kinds = [rng.randint(1, 30) for _ in range(n)], [rng.choice(["paragraph"] * 8 + ["heading", "key_value_group"]) for _ in range(n)]
        rows = [(i, k, " ".join(["w"] * (s - (k == "heading"))) or "", 1 if k == "heading" else None, None) for i, (s, k) in enumerate(zip(sizes, kinds))]
        sizes = [max(1, s) for s in sizes]
        d = one(spark, 1, [(k, c, lv, p) for _, k, c, lv, p in rows], schema=f"doc_id long, blocks array<{BLOCK}>")
        got = [(r.first_block, r.n_blocks) for r in chunks.chunked(d, 40, 10, overlap).orderBy("chunk").collect()]
        assert got == [(c[0], len(c)) for c in _chunks(sizes, kinds, 40, 10, overlap)]


def test_chunk_takes_nearest_heading(spark):
    b = [("heading", "H", 2, None), ("paragraph", "a b c", None, None), ("paragraph", "d e f", None, None)]
    got = chunks.chunked(one(spark, 1, b, schema=f"doc_id long, blocks array<{BLOCK}>"), 5, 1).orderBy("chunk").collect()
    assert [(r.heading, r.content) for r in got] == [("H", "## H\n\na b c"), ("H", "d e f")]


def test_issues_and_score_of_a_pdf(spark):
    b = [("heading", "A", 3, 1), ("heading", "B", 5, 1), ("paragraph", "x" * 10_001, None, 1), ("paragraph", " ", None, 3)]
    d = one(spark, 1, "pdf", 4, 5, b, schema=f"doc_id long, file_type string, pages int, original_tokens int, blocks array<{BLOCK}>")
    r = quality.readiness(quality.deductions(quality.issues(d))).first()
    assert [i.code for i in r.issues] == ["HEADING_HIERARCHY", "HEADING_SKIP", "LARGE_BLOCK", "EMPTY_BLOCK", "MISSING_PAGE", "MISSING_PAGE"]
    assert {x.rule_id: x.penalty for x in r.deductions} == {"MISSING_PAGE": 16, "LARGE_BLOCK": 4, "HEADING_ISSUES": 4}
    assert (r.readiness_score, r.quality_band) == (63, "RISKY")
    empty = one(spark, 1, "txt", 1, 0, [], schema=f"doc_id long, file_type string, pages int, original_tokens int, blocks array<{BLOCK}>")
    r = quality.readiness(quality.deductions(quality.issues(empty))).first()
    assert [i.code for i in r.issues] == ["EMPTY_DOCUMENT"] and r.readiness_score == 10


def test_scanned_pdf_records_what_it_suppresses(spark):
    d = one(spark, 1, "pdf", 4, 5, [("paragraph", "x", None, p) for p in range(1, 5)], True, 2, schema=f"doc_id long, file_type string, pages int, original_tokens int, blocks array<{BLOCK}>, ocr_required boolean, image_pages int")
    r = quality.readiness(quality.deductions(quality.issues(d))).first()
    assert {x.rule_id: (x.penalty, x.suppressed) for x in r.deductions} == {"OCR_REQUIRED": (30, False), "NEAR_EMPTY_OUTPUT": (25, True), "LOW_TEXT_DENSITY": (20, True), "NO_HEADINGS_MULTIPAGE": (6, False)}
    assert r.readiness_score == 51


def test_repetition_and_metrics(spark):
    t = "a b c d e f g h " * 60
    r = quality.ngram_repetition(docs(spark, t, "short", "")).orderBy("doc_id").collect()
    assert (r[0].max_count, r[0].preview, r[0].unsafe) == (60, "a b c d e f g h", True) and [x.max_count for x in r[1:]] == [0, 0]
    m = "# T\n\none two three four five\n```\ncode\n```\n| a |\n|---|\n12\nsame line here\nsame line here\n"
    r = quality.content_metrics(docs(spark, m, "")).orderBy("doc_id").collect()
    assert (r[0].heading_count, r[0].table_count) == (0, 2)  # three characters are noise before they are a heading
    assert (r[0].noise_line_count, r[0].duplicate_line_count, r[0].empty_line_count, r[0].line_count, r[1].line_count) == (2, 1, 1, 11, 0)
    s = quality.structural_metrics(docs(spark, "# H\n\npara\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n![x](y)")).first()
    assert (s.paragraphs, s.headings, s.image_refs, s.tables) == (2, 1, 1, 1)


@pytest.mark.parametrize(
    ("line", "want"),
    [("Name: Ann", ("Name", "Ann")), ("Note: x", None), ("The thing: x", None), ("a b c d e f: x", None), ("Key:", None), ("http://x", None), ("k: " + "v" * 81, None), ("T: 9:30", ("T", "9:30"))],
)
def test_field_lines(spark, line, want):
    got = value(spark, kv.parse(F.lit(line)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("v", "kind"),
    [("9:30 am", "time"), ("a@b.co", "email"), ("HTTP://x", "url"), ("1234567", "phone"), ("10-11-2024", "phone"), ("$5.00", "currency"), ("7.5%", "percentage"), ("12", "number"), ("1/2/2024", "date"), ("1/2/24", "text"), ("x", "text")],
)
def test_value_types(spark, v, kind):
    assert value(spark, kv.value_type(F.lit(v))) == kind


@pytest.mark.parametrize(
    ("lines", "exclusions", "promote"),
    [
        ("Email: a@b.co\nPhone: 555-123-4567", "", True), ("Anna: Yes.\nBert: No!", "dialogue", False), ("debug: true\nlevel: x", "configuration", False),
        ("Smith: 1999\nJones: 2001", "citation", False), ("Voltage: low\nWeight: big\nModel: q", "", True), ("Foo: x\nBar: y", "", False),
        ("Plan: rest\nHistory: none known", "medical_section", False),
    ],
)
def test_classifier(spark, lines, exclusions, promote):
    d = one(spark, 1, lines, schema="id int, content string")
    r = key_values.classified(key_values.typed(key_values.lines(d, ["id"])), ["id"]).first()
    assert (r.exclusions, r.promote) == (exclusions, promote)


def test_detected_groups_and_their_plan(spark):
    rows = [(1, "Email: a@b.co\nEmail: c@d.co"), (2, "Foo: x"), (3, "Monday: x\nFoo: y"), (4, "Link: https://x.y"), (5, "Foo: x"), (5, "Foo: y\nBar: z")]
    d = spark.createDataFrame(rows, "id int, content string")
    got = key_values.detected(key_values.typed(key_values.lines(d, ["id"])), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, 2, "contact", True), (3, 2, "schedule", False), (4, 1, "unknown", False), (5, 3, "unknown", True)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange")  # a child stands below: nothing is counted before the one shuffle


def test_records_split_at_a_repeated_key(spark):
    e = [("a", "1"), ("b", "2|3"), ("a", "4")]
    d = one(spark, e, schema="e array<struct<key:string,value:string>>")
    none = F.lit(None).cast("string")
    r = d.select(key_values.to_markdown(F.col("e"), F.lit("T")).alias("m"), key_values.to_tsv(F.col("e"), none).alias("t")).first()
    assert r.m == "#### T\n\n**Record 1**\n- **a:** 1\n- **b:** 2\\|3\n\n**Record 2**\n- **a:** 4"
    assert r.t == "[Record 1]\na\t1\nb\t2|3\n\n[Record 2]\na\t4"


def test_table_renderers(spark):
    d = one(spark, 1, 1, [["x", "x", ""], ["1|2", None, "c\nd"]], schema="table_id int, header_rows int, grid array<array<string>>")
    g, h = F.col("grid"), F.col("header_rows")
    r = d.select(tables.markdown(g).alias("m"), tables.tsv(g).alias("t"), tables.row_records(g, h).alias("r"), tables.preview(g, h, F.lit(None).cast("string"), F.lit(None).cast("string")).alias("p")).first()
    assert r.m == "| x | x |  |\n| --- | --- | --- |\n| 1\\|2 |   | c d |"
    assert (r.t, r.r) == ("x\tx\t\n1|2\t \tc d", "x_1=1|2; x_2=; =c d")
    assert r.p == "Table: Untitled\nRows: 1\nColumns: x, x, Col3\n\n1|2\t \tc d"


def test_table_ranges_mark_rows_too_long(spark):
    d = one(spark, 1, [["h"], ["a b"], ["c " * 30], ["d"]], schema="header_rows int, grid array<array<string>>")
    got = d.select(tables.ranges(F.col("grid"), F.col("header_rows"), 20).alias("r")).first().r
    assert [(x.row_start, x.row_end, x.oversize) for x in got] == [(0, 1, False), (2, 2, True), (3, 3, False)]


def test_table_signals(spark):
    d = one(spark, 1, 1, [["Col1", "b", "b"], ["x", None, "."], ["x", "", "."]], schema="table_id int, header_rows int, grid array<array<string>>")
    s = {r.name: (r.value, r.status) for r in table_quality.signals(d).collect()}
    assert s["missing_coordinate_count"] == ("1", "risk") and s["duplicate_row_count"] == ("1", "ok") and s["generic_header_count"] == ("1", "risk")
    assert s["duplicate_header_names"] == ("1", "risk") and s["median_cell_length"] == ("1.0", "ok") and s["explicit_empty_cell_count"] == ("1", "ok")
    f = table_quality.findings(table_quality.signals(d)).first()
    assert (f.structure_incomplete, f.header_uncertain, f.page_furniture) == (True, True, False)
    assert table_quality.overall(table_quality.signals(d)).first().status == "candidate_risk"


def test_minhash_coefficients_and_duplicates(spark):
    assert corpus.coefficients()[:2] == [(4043818985, 2891286100), (1027120929, 1448310775)]
    base = " ".join(f"w{i}" for i in range(400))
    d = docs(spark, base, base + " extra", base, "other text of no likeness at all here", "", None, "")
    assert sorted(map(tuple, corpus.duplicates(d, 0.5).collect()))[-1] == (6, 4)
    near = dict(map(tuple, corpus.duplicates(d, 0.8).collect()))
    assert near[1] == 0 and near[2] == 0 and 3 not in near


def test_packs_and_status(spark):
    s = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 50), ("a", 4, 1), ("b", 5, 10)], "g string, id long, tokens long")
    got = corpus.packs(s, "g", "id", 12).orderBy("chunk_index").collect()
    assert [(r.g, r.chunk_index, r.documents, r.token_count) for r in got] == [("a", 0, 2, 11), ("a", 1, 1, 50), ("a", 2, 1, 1), ("b", 3, 1, 10)]
    f = spark.createDataFrame([("x", None, "t", False), ("md", "e", "t", True), ("md", None, " ", False), ("md", None, "t", True), ("MD", None, "t", None)], "extension string, error string, text string, is_duplicate boolean")
    assert [r.category for r in corpus.status(f, ["md"]).collect()] == ["unsupported", "failed", "low_quality", "duplicate", "processed"]


def test_nearest_and_config(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.vec_id for r in search.nearest(v, q, 2).orderBy("rank").collect()] == [1, 3]
    assert search.nearest(v, q.limit(0), 2).count() == 0
    with pytest.raises(ValueError, match="metric"):
        search.check_config({"metric": "l2"}, {"metric": "ip"})


def test_answer_similarity(spark):
    s = lambda a, b: value(spark, evals.answer_similarity(F.lit(a), F.lit(b)))
    assert s("Cat ", "cat") == 1.0 and s("abcd", "abce") == 0.75 and s("xyz", "abc") == 0.0 and s("a", "") is None


def test_routes(spark):
    def r(kind, content="x", mode="adaptive", method=None, risky=False, box=False, cap=False, conf=None):
        n = F.lit(None).cast("int")
        return tuple(value(spark, route(F.lit(kind), F.lit(content), mode, F.lit(method).cast("string"), F.lit(risky), F.lit(box), F.lit(cap), n, n, F.lit(conf).cast("string"))))

    assert r("table") == ("markdown", "TABLE_LEGACY_MARKDOWN", False)
    assert r("table", method="html.native", risky=True, box=True) == ("structured_table", "TABLE_STRUCTURED_RISKY", True)
    assert r("image", mode="text_first")[1] == "IMAGE_EXCLUDED_TEXT_FIRST" and r("image", cap=True)[0] == "image"
    assert r("paragraph", " ")[0] == "omit" and r("paragraph", conf="ambiguous")[0] == "image_and_text"
    assert value(spark, ocr_choice(F.lit(10), F.lit(4), F.lit(True)))["backend"] == "vision"


def test_html_blocks():
    page = """<title>T</title><nav><p>skip</p></nav><h1>A <b>B</b></h1><p>one<br>two<p>three</p><ul><li>x<ol><li>y</ol><li>z</ul>
    <table><thead><tr><th>h<th colspan=2>i</thead><tr><td>1<td>2<td>3</table><dl><dt>k<dd>v</dl><div>a leaf of more than fifteen</div><div>short</div>
    <pre><code class="language-py">z = 1</code></pre><blockquote class="note">careful</blockquote><hr><img alt="pic" src="s"><script>var t="</p>"</script>"""
    got = html.blocks(page)
    kinds = [b["type"] for b in got]
    assert kinds[:2] == ["heading", "paragraph"] and "skip" not in str(got) and html.title(page) == "T"
    assert "three" in got[1]["content"]  # an unclosed paragraph holds what follows
    flat = html.blocks("<ul><li>x<ol><li>y</li></ol></li><li>z</li></ul><table><tr><th>a</th></tr><tr><td rowspan=2>b</td></tr><tr></tr></table>")
    assert flat[0]["content"] == "- x\n  1. y\n- z" and flat[1]["grid"] == [["a"], ["b"], [None]] and flat[1]["header_rows"] == 1
    assert html.blocks("") == [] and html.blocks("<div>" * 5000 + "x" * 30) is not None


def test_markdown_blocks():
    md = "# T\n\npara [l](u) x\nmore\n\n- a\n  - b\n1. c\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> [!NOTE] hey\n\n> q\n\n```py\ncode\n```\n!!! tip do\n\nUnder\n---\n"
    got = [(b["type"], b["content"]) for b in markdown.blocks(md)]
    assert got[0] == ("heading", "T") and got[1] == ("paragraph", "para l x\nmore") and got[2][0] == "list"
    assert ("table", "| a | b |\n|---|---|\n| 1 | 2 |") in got and ("admonition", "hey") in got and ("blockquote", "q") in got
    assert ("code_block", "code\n") in got and ("admonition", "do") in got and got[-1] == ("heading", "Under") and markdown.blocks("") == []


def test_structured_files():
    assert structured.summarise('{"a": [1, 2, 3, 4], "b": "x"}') == "**a** (list, 4 items)\n  [4 items]\n    1\n    2\n    3\n  ... 1 more\n**b**: x"
    assert structured.summarise("{") is None and structured.xml_blocks("<r><title>t</title><p a='1'>q</p></r>")[0]["content"] == "t"
    assert [b["content"] for b in structured.feed_blocks("<rss><channel><title>C</title><item><title>I</title></item></channel></rss>")] == ["C", "I"]


def test_files_of_many_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.eml").write_text("Subject: S\nFrom: a@b.co\n\nhello there\n> quoted\n")
    (tmp_path / "d.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# H"]}, {"cell_type": "code", "source": ["x"], "outputs": [{"text": ["out"]}]}]}))
    (tmp_path / "e.zip").write_bytes(b"not a zip")
    (tmp_path / "f.weird").write_text("?")
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("../up.txt", "inside")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert [b.content for b in got["a.txt"].blocks] == ["one", "two"] and got["e.zip"].category == "failed" and got["f.weird"].category == "unsupported"
    assert [b.type for b in got["d.ipynb"].blocks] == ["heading", "code_block", "blockquote"] and "hello there" in [b.content for b in got["c.eml"].blocks]
    assert "up.txt" in [b.content for b in got["g.zip"].blocks] and "| 1 | 2 |" in got["b.csv"].blocks[1].content


def test_ids(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    c = value(spark, ids.checksum(F.lit("é\r\n")))
    assert c == h("é\n") and value(spark, ids.block_id(F.lit("p"), F.lit(None).cast("int"), F.lit(3), F.lit(c))) == h(f"p:0:3:{c}")


def test_watched_folder_indexes_each_file_once(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.txt").write_text("good text")
    score = lambda d: d.select("path", F.size("blocks").alias("n"), F.when(F.size("blocks") > 0, 90).otherwise(10).alias("readiness_score"))
    for name, body in (("b.txt", "more"), ("c.txt", "")):
        ingest.watch(ingest.arrivals(spark, str(inbox)), table, str(tmp_path / "cp"), score).awaitTermination(60)
        (inbox / name).write_text(body)
    ingest.watch(ingest.arrivals(spark, str(inbox)), table, str(tmp_path / "cp"), score).awaitTermination(60)
    assert sorted(r.path[-5:] for r in spark.read.parquet(table).collect()) == ["a.txt", "b.txt"]


def test_queue(spark):
    jobs = spark.createDataFrame([("a", "h1", "done", 1), ("b", "h2", "error", 2)], "path string, content_hash string, status string, added_at long")
    found = spark.createDataFrame([("a", "h1", 5), ("b", "h2", 6), ("c", "h3", 4)], "path string, content_hash string, added_at long")
    q = ingest.enqueued(jobs, found)
    assert {r.path: r.status for r in q.collect()} == {"a": "done", "b": "pending", "c": "pending"} and ingest.oldest(q).first().path == "c"
    assert {r.status: r.n for r in ingest.stats(ingest.marked(q, spark.createDataFrame([("c", "low_quality")], "path string, status string"))).collect()} == {"done": 1, "pending": 1, "low_quality": 1}


@pytest.mark.parametrize("budget", [10, 50, 1000])
def test_packs_of_a_hot_group_over_many_parts(spark, budget):
    import random

    r = random.Random(budget)
    rows = [("hot", i, r.choice([0, 0, 1, 5, 9, 30, 60, 200])) for i in range(700)] + [("b", i, r.randint(0, 9)) for i in range(90)] + [(None, i, 7) for i in range(30)] + [(f"g{i}", 0, 5) for i in range(20)]
    got = {(x.g, x.o): x.pack for x in corpus.packed(spark.createDataFrame(rows, "g string, o int, tokens int"), "g", "o", budget).collect()}
    want, now, total, pack = {}, object(), 0, 0
    for g, o, n in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        if g != now:
            now, total, pack = g, 0, 0
        elif total + n > budget and total > 0:
            pack, total = pack + 1, 0
        total += n
        want[g, o] = pack
    assert got == want


def test_table_rejections_and_stitching_passes():
    from vellumry.operators import pdf

    t = lambda page, head, y0=400.0, y1=400.0: {"page": page, "header_rows": 1, "grid": [[head], [str(page)]], "y0": y0, "y1": y1, "height": 800.0}
    joined = pdf.stitched_tables([t(1, "a"), t(2, "a"), t(2, "a"), t(3, "a"), t(3, "b", y1=790.0), t(4, "c", y0=10.0), t(6, "c")])
    assert [(x["page"], len(x["grid"]), x["parts"]) for x in joined] == [(1, 5, [(1, 2), (2, 1), (2, 1), (3, 1)]), (3, 4, [(3, 2), (4, 2)]), (6, 2, [(6, 2)])]
    assert pdf.stitched_tables([]) == []


def test_tfidf_without_queries_or_matches(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "ALPHA alpha")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert search.tfidf(docs, none).count() == 0
    some = spark.createDataFrame([(1, "alpha"), (2, "nowhere"), (3, None)], "item_id long, text string")
    assert [tuple(r)[:3] for r in search.tfidf(docs, some, 1).collect()] == [(1, 1, 1)]
