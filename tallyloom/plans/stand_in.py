"""A scorer without a model, for the queries over the given tables: what it replies follows from a request's length."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd

from tallyloom.operators.scoring import REPLY


def rubric_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By a request's length it fails once, is always cut off, or is unreadable at first."""
    for b in batches:
        out = []
        for i, request, strict, attempt in zip(b["id"], b["request"], b["strict"], b["attempt"], strict=True):
            n = len(request)
            answer = json.dumps({"fields": {"description": 1 + (n * 7 + 1) % 10, "first_mes": 1 + (n * 7 + 2) % 10}})
            if n % 7 == 0 and attempt == 1:
                out.append((i, None, None, 500, "HTTP 500"))
            elif n % 13 == 0:
                out.append((i, answer[:-2], "length", 200, None))
            else:
                out.append((i, "no idea" if n % 5 == 0 and not strict else answer, "stop", 200, None))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLY.split(", ")]).astype({"status": "Int32"})
