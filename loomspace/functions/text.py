"""Words, terms, entities and text scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
COMMON = ("the", "and", "of", "to", "in", "a", "is", "was", "that", "it", "for", "on", "with", "as", "de", "la", "le", "et", "der", "die", "und", "el", "en", "que")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"), 1)


def token_estimate(text: Column) -> Column:
    """ceil(1.3 * words) over spaces."""
    n = F.size(F.array_remove(F.split(F.trim(text), "\\s+"), ""))
    return F.ceil(n * F.lit(1.3)).cast("long")


def summary(text: Column, n: int = 50) -> Column:
    return F.array_join(F.slice(F.array_remove(F.split(F.trim(text), "\\s+"), ""), 1, n), " ")


def truncated(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def mentions(text: Column) -> Column:
    """Entity candidates: words of two characters or more, trimmed of punctuation, not common, that start with a capital, are
    all capitals, or hold `_` or `-`; one of each in lower case, the first seen."""
    raw = F.transform(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: F.regexp_replace(w, "^[^\\p{L}\\p{N}_-]+|[^\\p{L}\\p{N}_-]+$", ""))
    kept = F.filter(raw, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*COMMON) & (w.rlike("^\\p{Lu}") | w.rlike("[_-]")))
    return F.array_distinct(F.transform(kept, F.lower))


def keyword_boost(word: Column) -> Column:
    """path +.5, version +.3, acronym +.3, proper noun +.2, common -.3, from 1, clamped to .5 .. 2."""
    b = 1.0 + F.when(word.rlike("/|\\\\|::"), 0.5).otherwise(0.0) + F.when(word.rlike("^v?[0-9]+\\.[0-9]+"), 0.3).otherwise(0.0)
    b = b + F.when(word.rlike("^[A-Z]{2,}$"), 0.3).otherwise(0.0) + F.when(word.rlike("^[A-Z][a-z]+$"), 0.2).otherwise(0.0) - F.when(F.lower(word).isin(*COMMON), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), b))


# Markers of code and of programming languages, a selection.
CODE = ("fn ", "def ", "class ", "import ", "return ", "->", "=>", "::", "();", "{}")
LANGUAGES = {"rust": ("fn ", "let mut", "impl "), "python": ("def ", "import ", "self."), "javascript": ("function ", "const ", "=>"), "go": ("func ", ":=", "package ")}


def code_query_type(text: Column) -> Column:
    """code2code for code, text2code for prose about code, else non_code."""
    return F.when(_any(text, CODE), "code2code").when(F.lower(text).rlike("\\b(function|code|implement|method|class)\\b"), "text2code").otherwise("non_code")


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def programming_language(text: Column) -> Column:
    """The language with most markers; ties by name; null without any."""
    counts = F.array(*(F.struct((-sum((text.contains(m).cast("int") for m in ms), F.lit(0))).alias("n"), F.lit(k).alias("lang")) for k, ms in LANGUAGES.items()))
    best = F.array_min(counts)
    return F.when(best["n"] < 0, best["lang"])


def expanded(text: Column, terms: tuple[str, ...]) -> Column:
    """The query with those terms appended that it lacks."""
    extra = [F.when(~F.lower(text).contains(x), F.lit(x)) for x in terms]
    return F.concat_ws(" ", text, *extra)
