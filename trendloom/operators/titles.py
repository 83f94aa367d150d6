"""Labels from titles: known phrases, phrases by the look of their words, abbreviations; the longest win."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Known topics and methods.
KNOWN = [
    "Few-Shot Learning", "Zero-Shot Learning", "Metric Learning", "Active Learning", "Semantic Segmentation", "Semantic Image Segmentation", "Image Segmentation",
    "Instance Segmentation", "Panoptic Segmentation", "Action Recognition", "Action Detection", "Video Action", "Point Cloud", "Point Cloud Registration", "Stereo Matching",
    "View Synthesis", "View Extrapolation", "Shape Representation", "Neural Architecture Search", "Architecture Search", "Reinforcement Learning", "Deep Reinforcement Learning",
    "Domain Adaptation", "Transfer Learning", "Self-Supervised Learning", "Semi-Supervised Learning", "Object Detection", "3D Detection", "Pose Estimation", "Depth Estimation",
    "Optical Flow", "Image Classification", "Few-Shot", "Zero-Shot", "Multi-View", "Single View", "RGB-D", "SLAM", "Visual SLAM", "Bundle Adjustment", "Feature Correspondence",
    "Hair Capture", "Scene Completion", "Image Inpainting", "View Inpainting", "Confidence Estimation", "High-Confidence Predictions", "Uncertainty", "Robustness", "Adversarial",
    "ReLU Networks", "Graph Neural Network", "GNN", "Denoising Autoencoders", "Autoencoder", "Training Data", "Multiple Choice Learning", "Dynamics Generalization",
    "Trajectory-wise", "Kervolutional", "Convolutional Networks", "Deep Networks", "Augmentation", "Data Augmentation", "AutoAugment", "Learning Augmentation", "Stereo",
    "Stereo Confidence", "Multiplane Images", "Signed Distance Functions", "Progressive Learning", "Spatio-Temporal", "Complex Action", "Video Action Detection", "Transformer",
    "Attention", "Self-Attention", "Neural Network", "Neural Networks", "Deep Network", "Auto-DeepLab", "Guided Aggregation", "Bundle Adjusted", "Direct RGB-D",
    "Structure From Motion", "Multi-View Geometry", "Volume-Guided", "Progressive View", "Video Action Transformer", "Timeception", "Spatio-Temporal Progressive",
    "Locally Adaptive Fusion", "Mining Reliable Neighbors", "Coordinate-Free", "Semidefinite-Based", "Randomized Approach", "Carlsson-Weinshall", "Category Traversal",
    "Edge-Labeling", "Classification Weights", "GNN Denoising", "Hierarchical Neural Architecture Search", "Hierarchical Prediction", "Fourier Basis",
    "Computational Resource Utilization", "Hardness-Aware", "Learning Loss", "Learning Augmentation Strategies", "SDRSAC", "BAD SLAM", "GA-Net", "LAF-Net", "NM-Net", "DeepSDF",
    "Large Vision-Language Models", "LVLMs", "Vision-Language", "Vision-Language Pre-Training", "Language-Contrastive Decoding", "LCD", "Hallucinations", "Scene Text Detectors",
    "Tool Learning", "Large Language Models", "Large-Scale Benchmarking", "Arabic Dialects", "NLP", "Common Assumptions",
]
# Words that no phrase begins with, ends with, is alone; how no label begins, and what none holds.
NO_START = frozenset("why how what when where and or the for with from via by to in on a an yield mitigate revealing pushing striking networks towards of revisiting about".split())
NO_END = frozenset("the to and from for in on a an far away about of towards".split())
NOT_ALONE = frozenset("learning network networks deep neural data method approach using for with from and the via by to in on based new real time high low multi single end".split())
NO_LABEL_START = ("for ", "by ", "with ", "from ", "and ", "to ", "in ", "on ", "via ", "the ", "why ", "how to ", "how ", "what ", "when ", "where ", "a ", "of ", "towards ", "revisiting ", "about ")
NOT_WITHIN = (" for ", " by ", " about ")


def _normal(text: str) -> str:
    return re.sub(r"[\s\-]+", " ", text.lower().strip())


@functools.lru_cache(maxsize=8)
def _spelt(known: tuple[str, ...]) -> list[tuple[str, str]]:
    """Spellings and phrases, longest first."""
    return sorted({_normal(p): p for p in known}.items(), key=lambda x: -len(x[0]))


def known_phrases(title: str, known: Sequence[str] = KNOWN, least_chars: int = 5) -> list[str]:
    """Known phrases that the title contains, longest first."""
    if len(title) < least_chars:
        return []
    have = _normal(title)
    return list(dict.fromkeys([p for n, p in _spelt(tuple(known)) if n in have]))


def _looks_technical(word: str) -> bool:
    return word.isupper() or "-" in word or re.match("[A-Z][a-z]", word) is not None


def phrases_by_look(title: str, most_words: int = 4) -> Iterator[str]:
    """From each word on up to so many words, ended by a word that no phrase begins with, or by a colon, after which all begins anew."""
    tokens = title.split()
    words = [t.rstrip(":,;") for t in tokens]
    ends = [w.lower() in NO_START for w in words]
    colons = [t.endswith(":") and (t == ":" or w != "") for t, w in zip(tokens, words, strict=True)]
    begin = 0
    while begin < len(tokens):
        if tokens[begin].lower() in NO_START:
            begin += 1
            continue
        run: list[str] = []
        colon = None
        for at in range(begin, len(tokens)):
            if colons[at]:
                run += [words[at]] if words[at] else []
                colon = at
                break
            if run and ends[at]:
                break
            run += [words[at]] if words[at] else []
            if len(run) == most_words:
                break
        phrase = " ".join(run)
        if len(run) == 1 and len(phrase) > 1 and _looks_technical(phrase):
            yield phrase
        elif len(run) > 1 and len(phrase) > 4 and (colon is not None or run[-1].lower() not in NO_END):
            yield phrase
        begin = begin + 1 if colon is None else colon + 1


def split_abbreviation(phrase: str) -> list[str]:
    """"Phrase (ABBR)" as [Phrase, ABBR]; any other phrase as itself."""
    m = re.search(r"\s*\(([A-Za-z0-9]{2,15})\)\s*$", phrase)
    return [p for p in (phrase[: m.start()].strip(), m[1]) if p] if m else [phrase]


def longest(phrases: Sequence[str], most: int = 14) -> list[str]:
    """From the shortest on, each takes the place of those within it; fragments and lone generic words are left out, and so many are kept."""
    kept: dict[str, str] = {}
    for phrase in sorted(phrases, key=lambda p: (len(p), p)):
        low = phrase.lower()
        if low in kept or low in NOT_ALONE or low.startswith(NO_LABEL_START) or any(w in low for w in NOT_WITHIN):
            continue
        kept = {k: p for k, p in kept.items() if k not in low} | {low: phrase}
        if len(kept) >= most:
            break
    return list(kept.values())


def title_keywords(title: str | None, most: int = 14) -> str:
    """Labels of a title, joined by "; "; empty if it is blank."""
    title = (title or "").strip()
    found: dict[str, str] = {}
    for phrase in [*known_phrases(title), *phrases_by_look(title)]:
        found.setdefault(phrase.lower(), phrase)
    return "; ".join(longest([part for p in found.values() for part in split_abbreviation(p)], most))


def from_titles(title: Column) -> Column:
    @F.pandas_udf("string")
    def run(titles: pd.Series) -> pd.Series:
        return titles.map(title_keywords, na_action=None)

    return run(title)
