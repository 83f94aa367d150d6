"""Labels from titles and texts by vocabulary, n-grams and frequency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.operators.extractors import Extractor, phrases_by

# A controlled vocabulary of topics and methods.
VOCABULARY = [
    "Few-Shot Learning", "Zero-Shot Learning", "Metric Learning", "Active Learning", "Semantic Image Segmentation", "Semantic Segmentation", "Image Segmentation", "Instance Segmentation",
    "Panoptic Segmentation", "Neural Architecture Search", "Reinforcement Learning", "Deep Reinforcement Learning", "Domain Adaptation", "Transfer Learning", "Self-Supervised Learning",
    "Semi-Supervised Learning", "Object Detection", "Pose Estimation", "Depth Estimation", "Optical Flow", "Point Cloud Registration", "Point Cloud", "Stereo Matching", "View Synthesis",
    "View Extrapolation", "RGB-D", "SLAM", "Visual SLAM", "Bundle Adjustment", "Feature Correspondence", "Graph Neural Network", "GNN", "Transformer", "Attention", "Self-Attention",
    "Large Vision-Language Models", "Vision-Language Pre-Training", "Vision-Language", "Large Language Models", "Tool Learning", "Scene Text Detectors", "Data Augmentation", "AutoAugment",
    "Neural Network", "Neural Networks", "Image Classification", "Action Recognition", "Action Detection", "Video Action Detection", "Image Inpainting", "Uncertainty", "Robustness",
    "Adversarial", "ReLU Networks", "Training Data", "Multiple Choice Learning", "Dynamics Generalization", "Convolutional Networks", "Deep Networks", "Signed Distance Functions",
    "Spatio-Temporal", "Complex Action", "Progressive Learning", "NLP", "Arabic Dialects", "Common Assumptions", "Hallucinations", "Language-Contrastive Decoding", "LCD", "LVLMs",
    "Large-Scale Benchmarking", "Structure From Motion", "Multi-View Geometry", "3D Detection", "Few-Shot", "Zero-Shot", "Multi-View",
]
# Labels of contests and years, which are no topics.
EXCLUDED = r"(?i)semeval\s+\d{4}\s+task|semeval\s+task|sem[e\-]?eval\s+\d*\s*task|\d{4}\s+task\s+\d+|\d{4}\s+task\b|\b(201[7-9]|202[0-5])\b"


def vocabulary_match(title: Column, vocabulary: Sequence[str] = VOCABULARY, most: int = 14, least_chars: int = 3) -> Column:
    """Phrases of a stated vocabulary that the title contains, longest first, ties in the vocabulary's order."""
    pairs: dict[str, str] = {}
    for phrase in vocabulary:
        pairs.setdefault(" ".join(phrase.lower().replace("-", " ").split()), phrase)
    ordered = sorted(pairs.items(), key=lambda p: -len(p[0]))
    listed = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in ordered])
    # The title is normalised once, not once a phrase.
    hits = X.let(X.normalise_phrase(title), lambda own: F.filter(listed, lambda v: F.contains(own, v["n"])))
    found = F.transform(hits, lambda v: v["p"])
    return F.when(F.length(F.coalesce(title, F.lit(""))) >= least_chars, F.slice(found, 1, most)).otherwise(F.array().cast("array<string>"))


def filtered_phrases(phrases: Column, single_stop: Sequence[str]) -> Column:
    """No contests, years or lone stop words; no phrase inside one of more words that is kept before it."""
    ordered = F.array_sort(F.transform(phrases, lambda p: F.struct((-F.size(F.split(F.trim(p), r"\s+"))).alias("w"), F.trim(p).alias("p"))))
    stop = F.array(*[F.lit(s) for s in single_stop])

    def step(kept: Column, x: Column) -> Column:
        low = F.lower(x["p"])
        bad = (x["p"] == "") | x["p"].rlike(EXCLUDED) | ((x["w"] == -1) & F.array_contains(stop, low)) | F.exists(kept, lambda k: F.contains(F.lower(k), low) & (F.lower(k) != low))
        return F.when(bad, kept).otherwise(F.concat(kept, F.array(x["p"])))

    return F.aggregate(ordered, F.array().cast("array<string>"), step)


# Generic single words of the two extractors, and words without content.
GENERIC = (
    "language models model learning neural network networks data text image images video videos detection segmentation object objects diffusion generation translation knowledge "
    "based method methods approach approaches training deep representation representations feature features visual vision natural processing recognition classification prediction "
    "inference optimization attention transformer transformers embedding embeddings 3d 2d multi single large small new using used different multiple various effective efficient "
    "better high low real state art task tasks problem problems results performance framework algorithm algorithms system systems information structure"
).split()
GENERIC_SHORT = (
    "language models model learning neural network networks data text image images video videos detection segmentation object objects based method methods approach approaches "
    "training deep representation feature features visual vision natural processing recognition classification prediction inference optimization attention transformer transformers "
    "embedding embeddings multi single large small new using used different multiple various effective efficient framework algorithm system task tasks semeval shared workshop "
    "challenge competition 2017 2018 2019 2020 2021 2022 2023 2024 2025"
).split()
COMMON = "the and for are but not you all can had her was one our out has his how new now old see way who did get its let put say she too use with this from have been more than when which that".split()
COMMON_FREQUENT = [*COMMON, "man", "boy"]
# What a sentence that speaks of methods holds.
METHOD_CUES = [
    "we propose", "we present", "we introduce", "we develop", "we use", "we employ", "we leverage", "we show", "we demonstrate", "propose a", "present a", "introduce a",
    "framework", "algorithm", "approach", "method", "model", "based on", "leveraging", "using ", "employing", "via ", "through ", "by ", "neural ", "deep ", "learning ",
    "transformer", "attention", "reinforcement", "optimization", "embedding",
]


def content_runs(words: Column, sizes: Sequence[int], stop: Sequence[str], least_chars: int = 0) -> Column:
    """Runs of so many words, sizes in the order given, each in order of place, without any stop word."""
    kept = F.transform(words, lambda w: F.when(~w.isin(*stop), w))
    made = X.let(kept, lambda own: F.flatten(F.array(*[X.runs(own, n) for n in sizes])))
    made = F.coalesce(made, F.array().cast("array<string>"))
    return F.filter(made, lambda p: F.length(p) >= least_chars) if least_chars else made


def specific_phrases(phrases: Column, stop: Sequence[str] = GENERIC) -> Column:
    """Longer phrases first, else in their order; lone generic words, and what lies within a phrase kept before, go."""
    ordered = F.array_sort(F.transform(phrases, lambda p, i: F.struct((-F.size(X.words(p, r"\S+"))).alias("w"), i.alias("i"), X.strip(p).alias("p"))))

    def step(kept: Column, x: Column) -> Column:
        low = F.lower(x["p"])
        bad = (x["p"] == "") | ((x["w"] == -1) & low.isin(*stop)) | F.exists(kept, lambda k: F.contains(F.lower(k), low) & (F.lower(k) != low))
        return F.when(bad, kept).otherwise(F.concat(kept, F.array(x["p"])))

    return F.aggregate(ordered, F.array().cast("array<string>"), step)


def topic_and_methods(title: Column, abstract: Column, most: int = 15) -> Column:
    """"Topic: a; b Methods: c; d": runs of the first two sentences and the title, and of sentences with a cue of methods; empty if there are none."""
    stop, half = [*GENERIC, *COMMON], most // 2
    title = F.coalesce(title, F.lit(""))
    text = X.strip(F.concat(title, F.lit(" . "), F.coalesce(abstract, F.lit(""))))
    runs = lambda c: content_runs(X.words(c), (3, 2, 1), stop, 4)
    cue = lambda s: F.lower(s).rlike("|".join(METHOD_CUES))

    def of(parts: Column) -> Column:
        methods = F.slice(F.array_distinct(F.flatten(F.transform(F.filter(parts, cue), runs))), 1, half)
        topics = F.slice(F.array_except(runs(F.concat(F.array_join(F.slice(parts, 1, 2), " "), F.lit(" "), title)), methods), 1, half)
        part = lambda name, found: F.when(F.size(found) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(found, 1, 8), "; ")))
        return F.concat_ws(" ", part("Topic", topics), part("Methods", methods))

    return F.when(F.length(text) < 20, "").otherwise(X.let(X.sentences(text), of))


def most_frequent(values: Column, most: int) -> Column:
    """The most frequent strings of an array, ties by first place: sorted once and cut into runs of equals, all within the row."""

    def of(ordered: Column) -> Column:
        differs = lambda j: (j == 0) | (F.get(ordered, j)["v"] != F.get(ordered, j - 1)["v"])

        def counted(starts: Column) -> Column:
            one = lambda j, k: F.struct((j - F.coalesce(F.get(starts, k + 1), F.size(ordered))).alias("w"), F.get(ordered, j)["i"].alias("i"), F.get(ordered, j)["v"].alias("v"))
            return F.transform(F.slice(F.sort_array(F.transform(starts, one)), 1, most), lambda x: x["v"])

        return X.let(F.filter(F.transform(ordered, lambda x, j: j), differs), counted)

    return X.let(F.sort_array(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), of)


def frequent_phrases(text: Column, most: int = 15) -> Column:
    """The most frequent runs of three and two content words of a text, filled up with single words, joined by "; ".

    Ties go to what comes first: runs of three before those of two, then by place.
    Generic words, and phrases within others, are left out; a null text and one of
    less than ten characters have none.  No row moves.
    """
    stop = sorted({*GENERIC, *COMMON_FREQUENT})
    top = lambda w, sizes: most_frequent(content_runs(w, sizes, stop), most)
    found = X.let(X.words(F.coalesce(text, F.lit("")), "[a-z]{3,}"), lambda w: F.slice(F.concat(top(w, (3, 2)), top(w, (1,))), 1, most))
    return F.when(F.length(X.strip(text)) >= 10, F.array_join(F.slice(specific_phrases(found), 1, most), "; ")).otherwise("")


def keyword_cascade(papers: DataFrame, extractor: Extractor | str | None = None, most: int = 15, weights: Broadcast | None = None) -> DataFrame:
    """papers with ``made``: topic and methods, else the extractor's phrases if one is given (or the built-in one's, if weights are), else frequent phrases; empty if the texts are short."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in papers.columns else F.lit("")
    text = X.strip(F.concat_ws(" ", *[F.nullif(has(c), F.lit("")) for c in ("title", "abstract", "TLDR")]))
    tried = [topic_and_methods(has("title"), has("abstract"), most)]
    if extractor is not None or weights is not None:
        tried.append(phrases_by(extractor, text, generic=GENERIC, least_chars=20, runs=(2, 4), diversity=0.75, most=most, few=most // 2, weights=weights))
    found = F.coalesce(*[F.nullif(t, F.lit("")) for t in tried], frequent_phrases(text, most))
    return papers.withColumn("made", F.when(F.length(text) < 15, "").otherwise(found))


def enriched(papers: DataFrame, extractor: Extractor | str | None = None, least: int = 10, most: int = 15, weights: Broadcast | None = None) -> DataFrame:
    """papers whose absent or short keywords are replaced by what the cascade makes, if anything."""
    keywords = X.update_where(X.is_short(F.col("keywords"), least), F.col("made"), F.coalesce("keywords", F.lit("")), empty_too=False)
    return keyword_cascade(papers, extractor, most, weights).select(*[keywords.alias(c) if c == "keywords" else F.col(f"`{c}`") for c in papers.columns])
