"""Words by which the graph scanner suspects a relationship."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers by type of relationship. Texts are compared in lower case, so those with capitals never match; that is kept.
GRAPH = {
    "contains": ("contains", "includes", "has", "module", "struct", "enum", "pub mod", "section", "chapter"),
    "scoped_by": ("scoped by", "within", "inside", "under", "in scope"),
    "imports": ("import", "use", "require", "include", "from", "extern crate", "mod"),
    "depends_on": ("depends on", "requires", "needs", "dependency", "prerequisite"),
    "requires": ("requires", "prerequisite", "must have", "needed"),
    "references": ("see:", "ref:", "see also", "links to", "references", "related to", "http://", "https://"),
    "cites": ("cites", "citing", "citation", "cited in", " v. ", "U.S.", "F.3d", "S.Ct.", "et al.", "supra", "infra", "id."),
    "interprets": ("interprets", "construes", "meaning of", "interpretation"),
    "distinguishes": ("distinguishes", "distinguishable", "differs from", "unlike"),
    "implements": ("impl", "implements", "implementation", "trait"),
    "complies_with": ("complies with", "compliant", "in compliance", "meets requirements"),
    "fulfills": ("fulfills", "satisfies", "meets", "achieves"),
    "extends": ("extends", "inherits", "derives", "subclass", "child of", "builds upon"),
    "modifies": ("modifies", "amends", "changes", "alters", "updates"),
    "supersedes": ("supersedes", "replaces", "succeeds", "newer version"),
    "overrules": ("overrules", "overruled", "invalidates", "vacates", "reverses"),
    "calls": ("calls", "invokes", "executes", "runs", "triggers", "fn ", "()"),
    "applies": ("applies", "applying", "application of", "uses method"),
    "used_by": ("used by", "consumed by", "client of", "caller"),
}


def counted(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text holds, in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))


def all_markers(text: Column) -> Column:
    """Markers of all types; one that several types have counts for each."""
    return counted(text, tuple(w for words in GRAPH.values() for w in words))


def counted_sql(words: tuple[str, ...], column: str = "t") -> str:
    """The SQL of ``counted`` over a lower-case column."""
    return "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains({column}, w)))"
