"""Cascade models in the XML format: stages of single-split stumps over upright rectangles."""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import SparkSession

from stumpwright.operators.detect import LeafCascade, LeafStage, LeafStump


def parse_cascade(text: str) -> LeafCascade:
    """A model from XML text. Tilted features and trees deeper than one split are refused."""
    root = ElementTree.fromstring(text)
    if root.find("cascade") is not None:
        root = root.find("cascade")
    number = lambda node, path: float(node.findtext(path, "nan"))
    features = []
    for f in root.findall("features/_"):
        if (f.findtext("tilted") or "0").strip() not in ("", "0"):
            raise ValueError("tilted features are not supported")
        rects = [r.text.split() for r in f.findall("rects/_")]
        features.append(tuple((int(x), int(y), int(w), int(h), float(k)) for x, y, w, h, k in rects))
    stages = []
    for s in root.findall("stages/_"):
        stumps = []
        for c in s.findall("weakClassifiers/_"):
            nodes, leaves = c.findtext("internalNodes", "").split(), c.findtext("leafValues", "").split()
            if len(nodes) != 4 or len(leaves) != 2:
                raise ValueError("only trees of a single split are supported")
            stumps.append(LeafStump(features[int(nodes[2])], float(nodes[3]), float(leaves[0]), float(leaves[1])))
        stages.append(LeafStage(number(s, "stageThreshold"), tuple(stumps)))
    return LeafCascade(tuple(stages), int(number(root, "width")), int(number(root, "height")))


def read_cascade(spark: SparkSession, path: str) -> LeafCascade:
    """A model from a file on any file system that Spark reads; a model file is small."""
    return parse_cascade(spark.read.text(path, wholetext=True).first().value)
