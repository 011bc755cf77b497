"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The tree is root - domain - language - source.  A token budget enters at the root
and is propagated by integer weights.  A node can take at most what its leaves
hold (tokens x ``max_epochs``); what it cannot take goes to its siblings by their
weights first, and only what a whole family cannot take climbs to the family of
its parent.  Filling every level by the capacities of whole subtrees does exactly
that.  All of it is integer arithmetic over one row a leaf.

A leaf's budget is spent in epochs: whole epochs first, then a prefix of the next
epoch's seeded order, as far as the running token count stays within the budget.
The order is that of md5(seed, epoch, doc_id); its first ``BUCKET_DIGITS``
hex digits are a bucket, and only the one bucket of a leaf that the budget ends
in is ever sorted, so a leaf with a third of all rows is no bottleneck.

A token is a word, a number or a run of other signs, counted exactly in whole texts;
exact counts of a tokenizer can be handed in as a column.  Budgets are rounded down, so a
family may leave as many tokens unspent as it has members.

Defined results: a null domain, language or source is a value of its own; a null or
empty text has no tokens, texts of any length are counted whole; rows with the same ``doc_id`` in a leaf stand or fall
together; a leaf of weight 0 gets nothing; an empty table gives an empty result;
columns that clash with names used here do no harm.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, text_of, unused

BUCKET_DIGITS = 3
#: A table of leaves up to this size is broadcast; a larger one is joined by its key.
BROADCAST_LEAVES = 50_000


@dataclass(frozen=True)
class Mix:
    """Integer weights by name at each level; names that are not listed weigh ``other``."""

    domains: Mapping[str, int] = field(default_factory=dict)
    langs: Mapping[str, int] = field(default_factory=dict)
    sources: Mapping[str, int] = field(default_factory=dict)
    other: int = 100
    #: The budget, as a share in thousandths of all tokens there are.
    budget_permille: int = 600
    max_epochs: int = 2
    seed: int = 11


def domain_of(source: str = "source") -> Column:
    """Documents have no domain column: sources are dealt into four domains by the first digit of their MD5."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.encode(F.coalesce(F.col(source).cast("string"), F.lit("")), "UTF-8")), 1, 1)) - 1
    return F.concat(F.lit("domain"), F.pmod(digit, F.lit(4)).cast("string"))


#: A token of a budget: a word, a number, or a run of other signs.
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


def token_count() -> Column:
    """Exact number of ``TOKEN`` in the whole text; counts of any tokenizer can be handed in instead."""
    return F.regexp_count(text_of(), F.lit(TOKEN)).cast("long")


def _weight(name: Column, weights: Mapping[str, int], other: int) -> Column:
    chosen = F.lit(other)
    for k, w in weights.items():
        chosen = F.when(name == F.lit(k), F.lit(w)).otherwise(chosen)
    return chosen.cast("long")


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Split each family's ``budget`` over its members by ``weight``, none above its ``cap``.

    Members are taken by cap / weight; the first that cannot be filled sets the level
    at which all later ones stand.
    """
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = (
        nodes.where("weight > 0")
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_from", F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("spare", F.col("budget") - F.col("cap_before"))
        .withColumn("open", F.col("cap") * F.col("w_from") > F.col("spare") * F.col("weight"))
        .withColumn("at", F.row_number().over(order))
    )
    level = F.min(F.when(F.col("open"), F.struct("at", "spare", "w_from"))).over(family)
    return (
        found.withColumn("level", level)
        .withColumn(
            "got",
            F.when(F.col("level").isNull() | (F.col("at") < F.col("level.at")), F.col("cap")).otherwise(
                F.expr("weight * level.spare div level.w_from")
            ),
        )
        .withColumn("got", F.least("cap", F.greatest("got", F.lit(0))))
        .drop("cap_before", "w_from", "spare", "open", "at", "level")
    )


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: domain, lang, source, tokens.  Adds ``budget``, in tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {mix.budget_permille} div 1000").alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total))  # one row
    domains = _fill(domains.withColumn("weight", _weight(F.col("domain"), mix.domains, mix.other)), [], "domain")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    langs = langs.join(domains.select("domain", F.col("got").alias("budget")), "domain")
    langs = _fill(langs.withColumn("weight", _weight(F.col("lang"), mix.langs, mix.other)), ["domain"], "lang")
    sources = leaves.join(langs.select("domain", "lang", F.col("got").alias("budget")), ["domain", "lang"])
    sources = _fill(sources.withColumn("weight", _weight(F.col("source"), mix.sources, mix.other)), ["domain", "lang"], "source")
    return sources.select("domain", "lang", "source", "tokens", F.col("got").alias("budget"))


def _order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))), "UTF-8"))


def _small(leaves: DataFrame) -> DataFrame:
    """A materialised table with a row a leaf, to be broadcast if it is small: rows then stay where they are,
    however many of them a leaf has."""
    return F.broadcast(leaves) if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else leaves


LEAF = ["domain", "lang", "source"]


def cutoffs(slim: DataFrame, mix: Mix, last: bool = False) -> DataFrame:
    """slim: domain, lang, source, doc_id, tokens (read three times; materialise it).

    A row a leaf: its whole epochs, and what of the next one it takes (``rest`` tokens): all buckets before
    ``end_bucket``, and of that one all keys up to ``last_key``.
    """
    leaves = slim.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    budgets = materialize(leaf_budgets(leaves, mix), "mix-budgets").select(
        *LEAF,
        F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 1 END").alias("epochs"),
        F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END").alias("rest"),
    )
    rows = slim.join(_small(budgets), LEAF).withColumn("order_key", _order_key(mix.seed, F.col("epochs"), F.col("doc_id")))
    rows = rows.withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    buckets = rows.groupBy(*LEAF, "bucket").agg(F.sum("tokens").alias("here"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*LEAF).orderBy("bucket")
    ends = (
        buckets.withColumn("upto", F.sum("here").over(run))
        .where("upto > rest")
        .groupBy(*LEAF)
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("here")).alias("before"))).alias("end"))
        .select(*LEAF, F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before"))
    )
    ends = materialize(ends, "mix-ends")
    # the rows of the one bucket of each leaf in which its budget ends; equal keys count together
    near = rows.join(_small(ends), LEAF).where("bucket = end_bucket")
    upto = Window.partitionBy(*LEAF).orderBy("order_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        near.withColumn("upto", F.col("before") + F.sum("tokens").over(upto))
        .where("upto <= rest")
        .groupBy(*LEAF)
        .agg(F.max("order_key").alias("last_key"))
    )
    found = budgets.join(ends, LEAF, "left").join(cuts, LEAF, "left")
    return materialize(found.select(*LEAF, "epochs", "rest", "end_bucket", F.coalesce("last_key", F.lit("")).alias("last_key")), "mix-cuts", last=last)


def copies_of(cuts: dict[str, Column], doc_id: Column, mix: Mix) -> Column:
    """How often a row is taken, by its leaf's cutoffs."""
    key = _order_key(mix.seed, cuts["epochs"], doc_id)
    inside = (F.substring(key, 1, BUCKET_DIGITS) < cuts["end_bucket"]) | (key <= cuts["last_key"])
    return cuts["epochs"] + F.coalesce(inside, cuts["rest"] > 0).cast("long")


def choose(slim: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``copies`` to ``slim``: how often a row is taken; rows that are not taken are absent."""
    cuts = cutoffs(slim, mix)
    rows = slim.join(_small(cuts), LEAF)
    return rows.withColumn("copies", copies_of({c: F.col(c) for c in cuts.columns}, F.col("doc_id"), mix)).where("copies > 0").select(*LEAF, "doc_id", "tokens", "copies")


def slim_rows(docs: DataFrame, tokens: Column | None = None, domain: Column | None = None) -> DataFrame:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return docs.select(
        (domain if domain is not None else domain_of()).alias("domain"),
        named("lang").alias("lang"),
        named("source").alias("source"),
        "doc_id",
        (tokens if tokens is not None else token_count()).alias("tokens"),
    )


def mix_documents(docs: DataFrame, mix: Mix, tokens: Column | None = None) -> DataFrame:
    """domain, lang, source, doc_id, tokens, copies of the rows that the mixture takes."""
    with scratch(docs.sparkSession):
        return materialize(choose(materialize(slim_rows(docs, tokens), "mix-rows"), mix), "mix-chosen", last=True)


def take_mixture(docs: DataFrame, mix: Mix, tokens: Column | None = None) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it; all columns as they were.

    Rows are decided where they are, by the cutoffs of their leaf: texts are not shuffled.
    """
    with scratch(docs.sparkSession):
        cuts = cutoffs(materialize(slim_rows(docs, tokens), "mix-rows"), mix, last=True)
    fresh = {c: unused(docs, f"_ts_{c}") for c in (*cuts.columns, "copies", "epoch")}
    cuts = cuts.select(*[F.col(c).alias(fresh[c]) for c in cuts.columns])
    named = lambda c: F.coalesce(docs[c].cast("string"), F.lit("(none)"))
    # a source is of one domain, so language and source are a whole key
    joined = docs.join(_small(cuts), (named("lang") == cuts[fresh["lang"]]) & (named("source") == cuts[fresh["source"]]))
    joined = joined.withColumn(fresh["copies"], copies_of({c: F.col(fresh[c]) for c in ("epochs", "rest", "end_bucket", "last_key")}, docs["doc_id"], mix)).where(F.col(fresh["copies"]) > 0)
    if mix.max_epochs > 1:
        joined = joined.withColumn(fresh["epoch"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(fresh["copies"]))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
