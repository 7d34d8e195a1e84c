"""Small frames with every awkward row, and plain Python versions of operators."""

from __future__ import annotations

import hashlib
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text: str | None) -> list[str]:
    out, at = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            if at:
                out.append(at)
            at = ""
        else:
            at += c
    return out


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "an", "er", "on", "re", "ou", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    """documents with the given (doc_id, text[, source]); an extra column whose
    name operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward():
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, base), (7, base), (7, base), (8, base.upper()),
        (9, " ".join(near)), (None, base), (None, None), (10, "Ünïcödé 😀 İI ſs"), (11, prose(2, 30_000)), (12, "x" * 50_000),
        (13, base, None), (14, "é" * 3), (15, "É" * 3),
    ]
