"""Key-value groups: fields found in blocks of text, classified, promoted and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kv, text
from ..functions.binding import let

#: A paragraph is looked at when it has at most so many characters and lines.
PARAGRAPH_CHARS, PARAGRAPH_LINES = 600, 20
MEDICAL = (
    "assessment", "chief complaint", "complaint", "diagnosis", "discharge summary", "examination", "findings", "history",
    "impression", "lab results", "physical exam", "plan", "prognosis", "recommendation", "review",
)
SWITCHES = ("0", "1", "disabled", "enabled", "false", "nil", "no", "none", "null", "off", "on", "true", "yes")
NUMBERED = r"^[0-9]+(?:\.[0-9]+)*$"
SCHEDULE_KEYS = ("friday", "monday", "saturday", "sunday", "thursday", "time", "tuesday", "wednesday")
CONTACT_KEYS = ("address", "email", "fax", "mobile", "phone", "telephone", "url", "website")


def lines(blocks: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, line_no, key, value): every line of the blocks that is a field, numbered from 0 among lines that aren't blank."""
    stripped = F.filter(F.transform(F.split(F.col(content), "\r\n|\r|\n"), text.strip), lambda x: x != "")
    marked = F.filter(F.transform(stripped, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.contains(s["x"], F.lit(":")))
    one = blocks.filter(F.contains(F.col(content), F.lit(":"))).select(*keys, F.explode_outer(marked).alias("l")).filter("l is not null")
    parsed = one.select(*keys, F.col("l.i").alias("line_no"), kv.parse(F.col("l.x")).alias("f"))
    return parsed.select(*keys, "line_no", "f.*").filter("key is not null")


def typed(fields: DataFrame) -> DataFrame:
    return fields.withColumn("value_type", kv.value_type(F.col("value"))).withColumn("normalized_key", kv.normal_key(F.col("key")))


def _count(test: Column) -> Column:
    return F.count_if(test)


def _schema_matches() -> Column:
    """struct(schema, n) with the most keys; of equals the one listed first."""
    k = F.col("normalized_key")
    hits = [F.struct(_count(k.isin(*v)).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("schema")) for i, (name, v) in enumerate(kv.SCHEMA_KEYS.items())]
    return F.greatest(*hits, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("rank"), F.lit("unknown").alias("schema")))


def classified(fields: DataFrame, keys: list[str]) -> DataFrame:
    """One row a block of typed fields: which exclusions hold, the schema that fits best, and whether to promote.

    Exclusions (conversation, settings, citations, section labels, numbered lists, clauses, definitions, medical notes,
    footnotes) come first and reject. Otherwise two strongly typed values, three schema keys, or one and two, promote.
    """
    k, v, n = F.col("key"), F.col("value"), F.count("*")
    ends = _count(v.rlike(r"[.?!]\s*$"))
    named, ident = _count(k.rlike("^[A-Z][a-z]+$")), _count(k.rlike("^[a-z_][a-z0-9_]*$"))
    years = _count(v.rlike(r"^(?:1[5-9][0-9]{2}|2[0-2][0-9]{2})[a-z]?$"))
    authors = _count(k.rlike(r"^[A-Z][a-z]+(?: et al\.?)?$"))
    section = r"^(?i)(?:Section|Clause|Article|Part|Chapter)\s+[0-9]"
    tests = [
        ("dialogue", (ends >= 2) | ((named >= 2) & (ends >= 1))),
        ("configuration", (ident == n) & ((_count(F.lower(v).isin(*SWITCHES)) >= 1) | (n >= 3))),
        ("citation", (years >= 2) | ((years >= 1) & (authors >= 1))),
        ("section_label", _count(k.rlike(section) | k.rlike(NUMBERED) | k.rlike("^(?i)Q[1-4]$")) >= 2),
        ("numbered_list", (_count(k.rlike(NUMBERED)) == n) & (n >= 2)),
        ("legal_clause", _count(k.rlike(r"^(?i)(?:Section|Clause|Article|Sub-?clause)\s+[0-9]")) >= 2),
        ("academic_definition", _count(v.rlike(r"^(?i)(?:an?|the)\s+")) >= 2),
        ("medical_section", _count(F.lower(k).isin(*MEDICAL)) >= 2),
        ("financial_footnote", _count(k.rlike(r"^(?:\([0-9a-zA-Z]\)|[0-9]+\.)$")) >= 2),
    ]
    out = fields.groupBy(*keys).agg(
        n.alias("entries"), _count(F.col("value_type").isin(*kv.STRONG_TYPES)).alias("strong"), _schema_matches().alias("_s"),
        F.array_compact(F.array(*[F.when(t, name) for name, t in tests])).alias("_x"),
    )
    enough = F.col("entries") >= 2
    out = out.withColumn("exclusions", F.when(enough, F.array_join("_x", ",")).otherwise(""))
    strong, fit = F.col("strong"), F.col("_s.n")
    promote = enough & (F.col("exclusions") == "") & ((strong >= 2) | (fit >= 3) | ((strong >= 1) & (fit >= 2)))
    reason = (
        F.when(~enough, "insufficient_candidates").when(F.col("exclusions") != "", F.concat(F.lit("exclusion_category:"), F.get("_x", F.lit(0))))
        .when(~promote, "insufficient_positive_evidence")
    )
    return out.select(
        *keys, "entries", F.when(enough, strong).otherwise(0).cast("bigint").alias("strong"),
        F.when(enough, F.col("_s.schema")).otherwise("unknown").alias("schema"), F.when(enough, fit).otherwise(0).cast("bigint").alias("schema_keys"),
        "exclusions", promote.alias("promote"), F.coalesce(reason, F.lit("")).alias("reason"),
    )


def detected(fields: DataFrame, keys: list[str]) -> DataFrame:
    """The earlier rule: a block is a group with two fields, or one whose value is a phone, mail or web address.

    Fields are brought together by block before anything is counted: nearly every field is a group of its own while keys
    are told apart, so that a hash table before the shuffle would hold a whole split without making it smaller. The number
    of partitions is given, since Spark joins small ones by their compressed size, a tenth of what is counted.
    """
    parts = int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = F.col("value_type")
    low = F.coalesce("normalized_key", F.lower("key"))
    narrow = fields.select(
        *keys, "key", t.isin("phone", "email", "url").alias("_link"), ((t == "time") | low.isin(*SCHEDULE_KEYS)).alias("_schedule"), (t.isin("email", "phone") | low.isin(*CONTACT_KEYS)).alias("_contact")
    ).repartition(parts, *keys)
    kind = F.when(F.bool_or("_schedule"), "schedule").when(F.bool_or("_contact"), "contact").otherwise("unknown")
    return (
        narrow.groupBy(*keys).agg(F.count("*").alias("entries"), F.bool_or("_link").alias("_link"), kind.alias("group_type"), (F.countDistinct("key") < F.count("*")).alias("duplicate_key"))
        .filter((F.col("entries") >= 2) | F.col("_link")).drop("_link")
    )


def records(entries: Column) -> Column:
    """Record number (from 1) of each entry of an array of (key, value): a key seen before in the record begins the next."""
    zero = F.struct(F.array().cast("array<int>").alias("no"), F.array().cast("array<string>").alias("seen"), F.lit(1).alias("n"))
    return F.aggregate(entries, zero, lambda s, e: F.when(
        F.array_contains(s["seen"], e["key"]),
        F.struct(F.array_append(s["no"], s["n"] + 1).alias("no"), F.array(e["key"]).alias("seen"), (s["n"] + 1).alias("n")),
    ).otherwise(F.struct(F.array_append(s["no"], s["n"]).alias("no"), F.array_append(s["seen"], e["key"]).alias("seen"), s["n"].alias("n"))), lambda s: s["no"])


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def to_markdown(entries: Column, title: Column) -> Column:
    """Bullets, under numbered records where a key repeats."""
    bullet = F.transform(entries, lambda e: F.concat(F.lit("- **"), _escaped(e["key"]), F.lit(":** "), _escaped(e["value"])))
    head = F.coalesce(F.concat(F.lit("#### "), title, F.lit("\n\n")), F.lit(""))
    return F.concat(head, _grouped(entries, bullet, "**Record ", "**"))


def _grouped(entries: Column, lines: Column, before: str, after: str) -> Column:
    """The lines of all records, under a title each where there are several. Records follow one another, so a record
    begins at the line whose number differs from the one before."""
    def body(no: Column) -> Column:
        titled = F.zip_with(lines, F.transform(no, lambda r, i: F.when((i == 0) | (F.get(no, i - 1) < r), F.concat(
            F.when(i > 0, F.lit("\n")).otherwise(""), F.lit(before), r.cast("string"), F.lit(after + "\n")
        )).otherwise("")), lambda x, t: F.concat(t, x))
        return F.array_join(F.when(F.array_max(no) > 1, titled).otherwise(lines), "\n")

    return let(records(entries), body)


def to_tsv(entries: Column, title: Column) -> Column:
    row = F.transform(entries, lambda e: F.concat(F.replace(e["key"], F.lit("\t"), F.lit(" ")), F.lit("\t"), F.translate(e["value"], "\t\n", "  ")))
    head = F.coalesce(F.concat(F.lit("["), title, F.lit("]\n")), F.lit(""))
    return F.concat(head, _grouped(entries, row, "[Record ", "]"))


def _looked_at() -> Column:
    """Paragraphs of 2 to PARAGRAPH_LINES lines and at most PARAGRAPH_CHARS characters that have a colon."""
    c = F.col("content")
    n = F.size(F.filter(F.split(c, "\r\n|\r|\n"), lambda x: text.strip(x) != ""))
    return (F.col("type") == "paragraph") & (F.length(c) <= PARAGRAPH_CHARS) & F.contains(c, F.lit("\n")) & F.contains(c, F.lit(":")) & n.between(2, PARAGRAPH_LINES)


def promoted(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (keys, type, content) of which the paragraphs that ``classified`` promotes are groups of fields, drawn as bullets."""
    fields = typed(lines(blocks.filter(_looked_at()), keys))
    good = classified(fields, keys).filter("promote").select(*keys)
    drawn = (
        fields.join(good, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "key", "value"))).alias("_e"))
        .select(*keys, to_markdown(F.transform("_e", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), F.lit(None).cast("string")).alias("_md"))
    )
    return blocks.join(drawn, keys, "left").withColumn("type", F.when(F.col("_md").isNotNull(), "key_value_group").otherwise(F.col("type"))).withColumn("content", F.coalesce("_md", "content")).drop("_md")


def possible(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entries, reason) of paragraphs with two fields or more that no exclusion rejects: what would be promoted, and
    what lacks evidence. The default profile only reports these."""
    c = classified(typed(lines(blocks.filter(_looked_at()), keys)), keys)
    return c.filter((F.col("entries") >= 2) & (F.col("exclusions") == "")).select(*keys, "entries", F.when(F.col("reason") == "", "heuristic_disabled").otherwise(F.col("reason")).alias("reason"))
