"""Stand-in models for the tests. Their vectors and answers mean nothing."""

import hashlib
import json
import re

import numpy as np

DIM = 16


def stub_embed(texts, task):
    """Reproducible directions, not of unit length."""
    out = []
    for text in texts:
        seed = int(hashlib.sha256(f"{task}{text}".encode()).hexdigest()[:8], 16)
        out.append((np.random.default_rng(seed).normal(size=DIM) * 3).tolist())
    return out


def stub_complete(system, prompt, schema):
    """Ranks backwards; answers with the first passage and one that was never given."""
    if "ranking" in schema["properties"]:
        numbers = [int(n) for n in re.findall(r"^\[(\d+)\]", prompt, re.M)]
        return json.dumps({"ranking": numbers[::-1]})
    refused = "moon" in prompt.rsplit("Question:", 1)[1]
    return json.dumps({"answer": "Net 45 days [1] and [9].", "citations": [1, 9], "refused": refused, "conflict": False})
