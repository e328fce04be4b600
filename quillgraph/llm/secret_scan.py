"""Secret scan over an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its content. A (blob, rule version) pair that the ledger already
holds is not scanned again; of the blobs with other pairs, one path's copy is written to a table of its own and scanned
there, so that no plan can scan the others. The ledger keeps what was found with each pair; old and new findings are joined
back to every path that holds the blob. Spans count code points, the end excluded.

Positions come from one regular expression used twice: the matches and the gaps between them alternate, so a running
sum of their lengths, over rows, gives each match's start, however many matches a text has.

Nulls: a null text is empty; a null path is a path like any other. Repeated rows get their findings each. Texts of any
length are scanned whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, written


@dataclass(frozen=True)
class Rule:
    """``least`` is the least length of ``group``: shorter matches are dropped after matching, as they use up text."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),  # a run of 24 is the same match as a run that is then found long enough
)
#: Public formats of further secrets.
MORE_RULES = (
    Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[ \t\r\n]+[A-Za-z0-9+/=]{16,})*(?:(?:[ \t\r\n]+[A-Za-z0-9+/=]+)?[ \t\r\n]*-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url", 2, r"\b[a-z][a-z0-9+.-]{1,20}://[^ \t\r\n\f\x0B:/@]+:[^ \t\r\n\f\x0B/@]+@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


#: A match and the gap before it, by rule: lengths in code points, and whether the match counts.
_PIECE = "array<struct<rank:int,i:int,gap:bigint,match:bigint,counts:boolean,kind:string>>"


def pieces(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost, non-overlapping matches of one rule with the gaps before them, as _PIECE."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"), groups.alias("group"))
    length = lambda c: F.char_length(c).cast("long")
    row = lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), length(x["gap"]).alias("gap"), length(x["match"]).alias("match"), (length(x["group"]) >= rule.least).alias("counts"), F.lit(rule.kind).alias("kind"))
    return F.when(text.rlike(rule.pattern), F.transform(zipped, row)).otherwise(F.array().cast(_PIECE))


def _bit(i: int) -> Column:
    return F.col("mask").bitwiseAND(F.lit(1 << i)) != 0


#: Blobs to scan are named to all executors up to this number (44 bytes each), and joined beyond it.
MOST_SENT = 1 << 18


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, text) rows against a ledger (blob, rule, found).

    Returns the addresses (path, blob); the findings (blob, found) of all addressed blobs that hold any, whether they
    were known or are new; and the pairs now scanned (blob, rule, found), which the caller appends to its ledger. Ledger
    rows without findings (a null, or no such column) do not say what was found, so their pairs are scanned again.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = versions.select("path", text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    addresses = written(held.select("path", "blob"), "blobs")
    wanted = addresses.groupBy("blob").agg(F.min(F.xxhash64("path")).alias("keeper"))
    todo, old = wanted.withColumn("mask", F.lit((1 << len(rules)) - 1)), None
    if ledger is not None and "found" in ledger.columns:
        rank = F.array_position(F.array(*(F.lit(r.key) for r in rules)), F.col("rule")).cast("int") - 1
        kept = ledger.filter(F.col("rule").isin([r.key for r in rules]) & F.col("found").isNotNull()).select("blob", "rule", "found", rank.alias("rank"))
        old = kept.join(addresses.select("blob"), "blob", "left_semi")
        known = old.groupBy("blob").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("known"))
        todo = wanted.join(known, "blob", "left").select("blob", "keeper", F.lit((1 << len(rules)) - 1).bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0)))).alias("mask")).filter("mask <> 0")
    todo = written(todo, "unseen-names")
    named = beside(todo.withColumnRenamed("blob", "unseen"), MOST_SENT)
    unseen = written(held.join(named, (F.col("blob") == F.col("unseen")) & (F.xxhash64("path") == F.col("keeper"))).select("blob", "mask", "text"), "unseen")
    by_rule = [F.when(_bit(i), pieces(F.col("text"), r, i)).otherwise(F.array().cast(_PIECE)) for i, r in enumerate(rules)]
    own = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = unseen.select("blob", F.explode(F.concat(*by_rule)).alias("p")).select("blob", "p.*").dropDuplicates(["blob", "rank", "i"])  # a copy may come twice where paths repeat
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("match")).over(own)).filter("counts")
    span = F.struct((F.col("end") - F.col("match")).alias("start"), "rank", "end", "kind")
    new = written(ends.groupBy("blob", "rank").agg(F.array_sort(F.collect_list(span)).alias("found")), "found")
    every = new if old is None else new.unionByName(_ranked(old))
    findings = every.filter(F.size("found") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    scanned = todo.select("blob", F.explode(F.array(*(F.when(_bit(i), F.struct(F.lit(i).alias("rank"), F.lit(r.key).alias("rule"))) for i, r in enumerate(rules)))).alias("r")).filter("r is not null").select("blob", "r.rank", "r.rule")
    return addresses, findings, scanned.join(new, ["blob", "rank"], "left").select("blob", "rule", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def _ranked(ledger: DataFrame) -> DataFrame:
    """One row a pair of a ledger, its spans' ranks those of today's rules."""
    pairs = ledger.groupBy("blob", "rank").agg(F.first("found").alias("found"))
    return pairs.select("blob", "rank", F.transform("found", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))).cast(SPANS).alias("found"))


def scan_paths(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(path, found) for every path, with what the ledger already knows, and the rows to append to the ledger."""
    addresses, findings, scanned = scan(versions, ledger, rules)
    return findings_by_path(addresses, findings), scanned


def findings_by_path(addresses: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, found) for every path; ``found`` is empty where nothing was found."""
    return addresses.join(findings, "blob", "left").select("path", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def render(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(rows: DataFrame, column: str, found: str, mark: str = "x") -> DataFrame:
    """Replaces every character of the found spans by ``mark``; overlapping spans are masked once."""
    text, spans_ = F.coalesce(F.col(column), F.lit("")), F.array_sort(F.coalesce(F.col(found), F.array().cast(SPANS)))

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(s["start"], acc["at"])
        width = F.greatest(s["end"] - start, F.lit(0))
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["out"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(start - acc["at"], F.lit(0)).cast("int")), F.repeat(F.lit(mark), width.cast("int")))).alias("out"))

    folded = F.aggregate(spans_, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), step)
    masked = F.concat(F.array_join(folded["out"], ""), F.substring(text, (folded["at"] + 1).cast("int"), F.lit(2147483647)))
    return rows.withColumn(column, F.when(F.size(spans_) > 0, masked).otherwise(F.col(column)))
