"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, known by its SHA-256. A ledger holds which (blob, rule version) pairs were scanned
and what was found. A run scans only pairs that the ledger doesn't have, each blob once however many rows hold it, and
joins the findings back to all rows that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loadgrid.operators.tables import written

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """kind: its name in findings. least: the shortest group that counts. A changed rule gets another version."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: In the order in which findings of one place are listed.
RULES = (
    Rule("assign", _ASSIGN, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs of [0-9a-f]+ that are long enough: a run can't overlap another
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
SPAN = "struct<start:long,kind:string,end:long>"
#: Matches whose places are summed up at a time, so that a text with very many costs little more for each.
BLOCK = 512


def _let(x: Column, f) -> Column:
    """f of x, with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, kind, end) of the rule's matches, leftmost first and not overlapping, in code points."""
    none = F.array().cast(f"array<{SPAN}>")
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), groups.alias("value"))
    sizes = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), (F.length(x["value"]) >= rule.least).alias("counts")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["whole"]
        found = F.when(x["counts"], F.concat(acc["found"], F.array(F.struct(start.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end"))))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    # start of match i: the texts between matches up to it, and the matches before it; first within blocks, then over them
    own = lambda block: F.aggregate(block, F.struct(F.lit(0).cast("long").alias("at"), none.alias("found")), step)
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: own(F.slice(x, k * BLOCK + 1, F.lit(BLOCK))))
    before = lambda done: F.aggregate(done, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
    moved = lambda found, by: F.transform(found, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))
    placed = lambda done: F.flatten(F.zip_with(done, F.slice(before(done), F.lit(1), F.size(done)), lambda d, by: moved(d["found"], by)))
    # texts without a match aren't split
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), _let(sizes, lambda x: _let(blocks(x), placed))).otherwise(none)


def scan(blobs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(blob, kind, version, spans) of blobs (blob, text, due), one row per blob and rule of those in due; no others are tried."""
    version = lambda r: F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))
    each = (F.when(F.array_contains("due", version(r)), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules)
    return blobs.select("blob", F.inline(F.array_compact(F.array(*each))))


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, text): every row with the digest of its text; null counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger's new rows (blob, kind, version, spans): what docs holds that ledger has not scanned under rules.

    A blob is scanned for those rules alone whose (kind, version) the ledger lacks for it. Without a ledger all are scanned.
    """
    rows = versions(docs, id_col, text_col)
    due = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    if ledger is None:
        return scan(rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("due", due), rules)
    wanted = rows.select("blob").distinct().select("blob", F.inline(due))
    unseen = wanted.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
    unseen = unseen.groupBy("blob").agg(F.collect_list(F.struct("kind", "version")).alias("due"))  # at most one for each rule
    new = rows.join(unseen.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
    return scan(new.join(unseen, "blob"), rules)


def findings(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """Every row of docs as (id_col, blob, spans), spans sorted by start, then the rules' order, of their present versions."""
    current = ledger.where(F.concat_ws("/", "kind", F.col("version").cast("string")).isin([f"{r.kind}/{r.version}" for r in rules]))
    # written, so that the join deals both sides out anew and Spark may split a blob that many rows hold
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    keyed = F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("order"), s["kind"].alias("kind"), s["end"].alias("end")))
    plain = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    by_blob = written(current.groupBy("blob").agg(plain.alias("spans")))
    rows = versions(docs, id_col, text_col).select("id", "blob")
    return rows.join(by_blob, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, blob, spans) of every row of docs, scanning what the ledger lacks.

    Null and empty texts have no spans. Rows are kept as they are, also repeated ones and those with a null id. Other
    columns have no effect. An empty table gives an empty result.
    """
    new = update_ledger(docs, ledger, rules, id_col, text_col)
    return findings(docs, new if ledger is None else ledger.select(new.columns).unionByName(new), id_col, text_col, rules)
