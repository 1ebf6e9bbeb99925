"""Types of relationships between memories, and mechanisms of causal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category -> type -> the words that name it.
TYPES = {
    "containment": {"contains": ("contains", "contain", "has", "includes"), "scoped_by": ("scoped_by", "scoped by", "within")},
    "dependency": {"depends_on": ("depends_on", "depends on", "dependency"), "imports": ("imports", "import", "uses", "use"), "requires": ("requires", "require", "prerequisite")},
    "reference": {
        "references": ("references", "reference", "refs", "see", "links", "links_to"),
        "cites": ("cites", "cite", "citation"),
        "interprets": ("interprets", "interpret", "construes"),
        "distinguishes": ("distinguishes", "distinguish", "differentiates"),
    },
    "implementation": {"implements": ("implements", "implement", "impl"), "complies_with": ("complies_with", "complies with", "compliant"), "fulfills": ("fulfills", "fulfill", "satisfies")},
    "extension": {
        "extends": ("extends", "extend", "inherits", "inherit"),
        "modifies": ("modifies", "modify", "amends", "amend"),
        "supersedes": ("supersedes", "supersede", "replaces"),
        "overrules": ("overrules", "overrule", "overruled", "invalidates"),
    },
    "invocation": {"calls": ("calls", "call", "invokes", "invoke"), "applies": ("applies", "apply", "uses_as"), "used_by": ("used_by", "used by", "consumed_by", "consumed by")},
}
NONE = ("none", "invocation")  # of any other word


def taxonomy(spark: SparkSession) -> DataFrame:
    """(word, type, category)."""
    rows = [(w, kind, c) for c, kinds in TYPES.items() for kind, words in kinds.items() for w in words]
    return spark.createDataFrame(rows, "word string, type string, category string")


def named(rows: DataFrame, word: str) -> DataFrame:
    """Rows with the type and category that a word names, in any case and trimmed; ``none`` for other words and nulls."""
    own = taxonomy(rows.sparkSession).withColumnRenamed("word", "_word")
    kept = rows.join(F.broadcast(own), F.lower(F.trim(F.col(word))) == F.col("_word"), "left").drop("_word")
    return kept.withColumn("type", F.coalesce("type", F.lit(NONE[0]))).withColumn("category", F.coalesce("category", F.lit(NONE[1])))


# Mechanisms and the words taken for them; any other is direct.
MECHANISMS = {"mediated": ("mediated", "indirect"), "feedback": ("feedback", "bidirectional", "loop"), "temporal": ("temporal", "sequence")}


def mechanism(raw: Column) -> Column:
    out = None
    for name, words in MECHANISMS.items():
        hit = F.lower(raw).isin(*words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("direct")


def edge_direction(source: Column, target: Column) -> Column:
    """forward from a cause to an effect, backward from an effect to a cause, else symmetric."""
    return F.when((source == "cause") & (target == "effect"), "forward").when((source == "effect") & (target == "cause"), "backward").otherwise("symmetric")
