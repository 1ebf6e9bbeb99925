"""Causal chains, rankings and discovery scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..session import written
from ..sources.tables import part
from .neighbours import across
from .temporal import pairs_in_time

ATTENUATION, LONGEST = 0.9, 10  # fixed values of chain scoring


def chain_scores(memories: DataFrame) -> DataFrame:
    """Per chain (memory_id order): mean hop (x 1.2), the 0.9^i-weighted mean and the attenuated product. More than ten
    hops give a product of 0, none give 1."""
    w = W.partitionBy("chain").orderBy("memory_id")
    hop = v.cosine(part("E5_effect"), F.col("next"))
    x = memories.withColumn("next", F.lead(part("E5_cause")).over(w)).withColumn("i", F.row_number().over(w) - 1)
    x = x.withColumn("s", F.when(F.col("next").isNotNull(), hop)).withColumn("f", F.pow(F.lit(ATTENUATION), F.col("i")))
    product = F.aggregate(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("i", (F.col("s") * F.col("f")).alias("p"))))), F.lit(1.0), lambda a, e: a * e["p"])
    weight = F.sum(F.when(F.col("s").isNotNull(), F.col("f")))
    return x.groupBy("chain").agg(
        F.count("s").alias("hops"), F.round(F.avg(F.least(F.lit(1.0), F.col("s") * 1.2)), 6).alias("mean_hop"),
        F.round(F.sum(F.col("s") * F.col("f")) / weight, 6).alias("attenuated"), F.round(F.when(F.count("s") > LONGEST, 0.0).otherwise(product), 6).alias("product"),
    )


def abduction(e1: Column, e5: Column) -> Column:
    return (0.8 * e1 + 0.2 * e5) * 0.8


def prediction(e1: Column, e5: Column) -> Column:
    return F.least(F.lit(1.0), (0.8 * e1 + 0.2 * e5) * 1.2)


# Phrases that ask for causes, for effects, and words that negate what follows.
# fmt: off
CAUSE_PHRASES = (
    "why ", "why?", "what cause", "what causes", "what caused", "reason for", "reasons for", "reason behind", "because of what", "due to what",
    "what led to", "what leads to", "explain why", "how come", "diagnose", "root cause", "investigate", "debug", "troubleshoot", "trigger",
    "source of", "origin of", "culprit", "underlying", "responsible for", "attributed to", "blame", "how did", "where did", "when did",
    "failure mode", "etiology", "pathogenesis", "root of", "is attributed to", "driven by", "is mediated by", "contributes to", "accounts for",
    "determines the", "influences the", "regulates the", "was caused by", "resulted from", "stems from", "arises from", "originates from",
    "derives from", "emerged from", "factor in", "factors in", "basis of", "basis for", "driving force", "primary driver", "key driver", "depends on",
    "dependent on", "contingent on", "conditional on", "prerequisite for", "causation", "causal mechanism", "causal factor", "antecedent",
    "precursor", "precipitating factor", "determinant of", "mechanism underlying", "pathways leading to", "factors influencing",
    "variables affecting", "predictors of", "correlates of", "we hypothesize that", "our hypothesis is", "posit that", "we propose that",
    "we suggest that", "molecular basis of", "regulatory mechanisms", "signaling cascade", "feedback loop", "upstream regulator",
    "transcriptional control", "epigenetic modification", "gene expression", "protein interaction", "independent variable", "controlled experiment",
    "manipulated variable", "treatment group", "intervention study", "causes ", "what drives", "drives ", " via ", "by what pathway",
    "through what mechanism", "by what causal",
)
EFFECT_PHRASES = (
    "what happen", "what will happen", "what would happen", "consequence of", "consequences of", "result of", "results of", "effect of", "effects of",
    "impact of", "outcome of", "if i ", "if you ", "what does it do", "what will it do", "then what", "leads to", "lead to", "led to", "downstream",
    "cascades to", "cascading", "propagates to", "ripple effect", "side effect", "collateral", "knock-on", "ramifications", "predict", "forecast",
    "anticipate", "expect", "prognosis", "complications", "sequelae", "results in", "result in", "resulted in", "causes an increase",
    "causes a decrease", "produces a decrease", "induces changes", "initiates the process", "as a consequence", "as a result", "consequently",
    "therefore", "hence", "thus", "accordingly", "brings about", "gives rise to", "culminates in", "eventuates in", "manifests as",
    "correlation with", "associated with", "linked to", "related outcome", "secondary effect", "tertiary effect", "downstream effect", "will lead to",
    "will result in", "would cause", "could result", "might lead to", "likely to cause", "implications of", "repercussions of", "aftermath of",
    "fallout from", "phenotypic outcome", "downstream target", "end result", "clinical manifestation", "observable effect", "measurable outcome",
    "functional consequence", "biological response", "physiological change", "statistically significant", "p-value indicates", "confidence interval",
    "significant difference", "significant increase", "significant decrease", "dose-response relationship", "therapeutic effect", "adverse outcome",
    "treatment outcome", "clinical outcome", "dependent variable", "outcome measure", "response variable", "experimental outcome", "study endpoint",
    "causes ", "how does this affect", "how will this affect", "what changes when", "how does this impact", "what is the result",
    "what are the effects", "what are the consequences", "what's the impact", "results from", "outcomes of", "what follows", "follows from",
    "affect ", "cascade ", "escalate ",
)
NEGATIONS = (
    "not ", "no ", "never ", "n't ", "neither ", "without ", "cannot ", "can't ", "won't ", "doesn't ", "don't ", "isn't ",
)
# fmt: on
TEXTS = 256  #: texts that are looked through at once
NEGATED = 15  #: characters before a phrase in which a negation counts


def phrase_count(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases a lower-case text holds whose first place isn't negated."""
    place = lambda p: F.call_function("locate", p, text)
    before = lambda p: F.substr(text, F.greatest(F.lit(1), place(p) - NEGATED), F.least(F.lit(NEGATED + 1), place(p)))
    negated = lambda p: F.exists(F.array(*map(F.lit, NEGATIONS)), lambda n: F.contains(before(p), n))
    return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: (place(p) > 0) & ~negated(p)))


def first_places(text: np.ndarray, start: np.ndarray, phrases: tuple[bytes, ...]) -> dict[bytes, tuple[np.ndarray, np.ndarray]]:
    """Of each phrase, of four bytes or more, the texts that hold it and its first place in each. Texts are one array of bytes and their starts, the
    end last. All phrases are looked for in one pass: their first four bytes by a table of hashes, the others where those are met."""
    head = lambda p: int.from_bytes(p[:4], "little")
    hashed = lambda x: (x * np.uint32(2654435761)) >> np.uint32(16)
    table = np.zeros(1 << 16, bool)
    table[hashed(np.array([head(p) for p in phrases], "uint32"))] = True
    if len(text) < 4:
        return {}
    grams = np.lib.stride_tricks.as_strided(text, (len(text) - 3, 4), (1, 1)).copy().view("<u4")[:, 0]
    at = np.flatnonzero(table[hashed(grams)])
    order = np.argsort(grams[at], kind="stable")
    at, found = at[order], grams[at][order]
    padded = np.concatenate([text, np.zeros(max(map(len, phrases)), np.uint8)])
    out = {}
    for p in phrases:
        here = at[np.searchsorted(found, head(p), "left") : np.searchsorted(found, head(p), "right")]
        for k, x in enumerate(p[4:], 4):
            here = here[padded[here + k] == x]
        doc = np.searchsorted(start, here, "right") - 1
        inside = here + len(p) <= start[doc + 1]
        doc, first = np.unique(doc[inside], return_index=True)
        out[p] = doc, here[inside][first]
    return out


def held_phrases(texts: pa.Array, *kinds: tuple[str, ...]) -> list[np.ndarray]:
    """As ``phrase_count``, of lower-case texts, for each of several kinds of phrases."""
    out = [np.zeros(len(texts), "int64") for _ in kinds]
    for at in range(0, len(texts), TEXTS):
        part = texts[at : at + TEXTS].cast(pa.large_string())
        start = np.frombuffer(part.buffers()[1], "int64")[part.offset : part.offset + len(part) + 1]
        text = np.frombuffer(part.buffers()[2] or b"", np.uint8)[start[0] : start[-1]]
        start = start - start[0]
        held = first_places(text, start, tuple({p.encode() for ps in kinds for p in ps}))
        for n, phrases in zip(out, kinds):
            for p in phrases:
                for doc, place in zip(*held.get(p.encode(), ((), ()))):
                    # whole characters, of at most four bytes, and the first of the phrase
                    before = bytes(text[max(start[doc], place - 4 * NEGATED) : place]).decode(errors="ignore")[-NEGATED:] + p[0]
                    n[at + doc] += not any(x in before for x in NEGATIONS)
    return out


def intent(text: Column) -> Column:
    """cause, effect or unknown: which kind of phrase is held more often; cause if both are equally often, but not none."""

    @F.arrow_udf("string")
    def kind(texts: pa.Array) -> pa.Array:
        c, e = held_phrases(texts, CAUSE_PHRASES, EFFECT_PHRASES)
        return pa.array(np.where((c >= e) & (c > 0), "cause", np.where(e > c, "effect", "unknown")).tolist(), pa.string())

    return kind(F.lower(F.coalesce(text, F.lit(""))))


# Phrases of the scanner that speak of causes and of effects.
CAUSE_MARKERS = ("because", "due to", "caused by", "result of", "led to", "since", "as a result of", "owing to", "thanks to", "on account of", "stems from", "arises from", "originates from", "triggered by")
EFFECT_MARKERS = ("therefore", "consequently", "as a result", "thus", "hence", "so", "accordingly", "resulting in", "leading to", "causing", "produces", "yields", "generates", "brings about")


def markers(text: Column) -> Column:
    """How many of the scanner's phrases a text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(m)).cast("int") for m in CAUSE_MARKERS + EFFECT_MARKERS), F.lit(0))


def pair_score(markers: Column, same_session: Column, shorter: Column, sim: Column) -> Column:
    """Score of a candidate pair of the causal scanner, the earlier first: .15 a marker of both texts, .1 for the order and for one
    session, .05 each where the shorter text has more than 100 and 300 characters, .1 for a cosine in [.5, .8]."""
    parts = (F.when(same_session, 0.1), F.when(shorter > 100, 0.05), F.when(shorter > 300, 0.05), F.when(sim.between(0.5, 0.8), 0.1))
    raw = markers * 0.15 + 0.1 + sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def scan_in_time(memories: DataFrame, low: int = 10, high: int = 86_400, near: tuple[float, float] = (0.5, 0.9)) -> DataFrame:
    """(a, b, score): the scanner's pairs among memories (memory_id, user_id, s, E1, n characters, k markers), the earlier first: ``low``
    to ``high`` seconds apart and with a cosine in ``near``. Scores are those of ``pair_score``."""

    def found(a: pd.DataFrame, b: pd.DataFrame, cos: np.ndarray, ok: np.ndarray) -> pd.DataFrame:
        cos = np.round(cos, 9)
        i, j = np.nonzero(ok & (cos >= near[0]) & (cos <= near[1]))
        p, q, sim = a.iloc[i], b.iloc[j], cos[i, j]
        of = lambda c: (p[c].to_numpy(), q[c].to_numpy())
        users = of("user_id")
        shorter, marks = np.minimum(*of("n")), np.add(*of("k"))
        raw = marks * 0.15 + 0.1 + 0.1 * (users[0] == users[1]) + 0.05 * (shorter > 100) + 0.05 * (shorter > 300) + 0.1 * ((sim >= 0.5) & (sim <= 0.8))
        return pd.DataFrame({"a": p["memory_id"].to_numpy(), "b": q["memory_id"].to_numpy(), "score": np.clip(raw, 0, 1)})

    return pairs_in_time(memories, "E1", low, high, found, "a long, b long, score double")


def effect_chains(memories: DataFrame, starts: DataFrame, at_least: float = 0.5, longest: int = LONGEST) -> DataFrame:
    """(start, hop, memory_id, sim): from each start's vector (start, v) the memory (memory_id, cause, effect) whose cause is nearest by raw
    cosine, then from that one's effect the next that isn't in the chain yet, while the cosine is ``at_least``; ties by the smaller id.

    A hop is one product of all chains' ends with all causes: of each end's hop + 1 nearest, one at least is new."""
    causes = written(memories.filter("memory_id is not null").select("memory_id", F.col("cause").alias("v"), "effect"))
    ends = written(starts.select("start", "v", F.array().cast("array<bigint>").alias("seen")))
    out = []
    for hop in range(1, longest + 1):
        near = across(ends.select(F.col("start").alias("memory_id"), "v"), causes.select("memory_id", "v"), hop, itself=True)
        near = near.select(F.col("source").alias("start"), F.col("target").alias("memory_id"), F.round(2 * F.col("sim") - 1, 9).alias("sim")).filter(F.col("sim") >= at_least)
        fresh = ends.select("start", "seen").join(near, "start").filter(~F.array_contains("seen", F.col("memory_id")))
        best = fresh.groupBy("start").agg(F.min(F.struct((-F.col("sim")).alias("less"), "memory_id", "seen")).alias("b")).select("start", F.col("b.memory_id").alias("memory_id"), (-F.col("b.less")).alias("sim"), "b.seen")
        step = written(best.join(causes.select("memory_id", "effect"), "memory_id"))
        if step.isEmpty():
            break
        out.append(step.select("start", F.lit(hop).alias("hop"), "memory_id", "sim"))
        ends = step.select("start", F.col("effect").alias("v"), F.concat("seen", F.array("memory_id")).alias("seen"))
    none = memories.sparkSession.createDataFrame([], "start long, hop int, memory_id long, sim double")
    return reduce(DataFrame.unionByName, out) if out else none
