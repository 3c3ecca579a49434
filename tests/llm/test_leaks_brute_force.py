"""Leaks against all diagonals of all documents and passages."""

from __future__ import annotations

import numpy as np
import pandas as pd

from sphaera.llm import contamination
from sphaera.llm.queries import p7_found


def carried_on_one_diagonal(doc: np.ndarray, passage: np.ndarray) -> bool:
    equal = doc[:, None] == passage[None, :]
    for d in range(-len(passage) + 30, len(doc) - 29):
        on = np.diagonal(equal, -d)
        if on.sum() < 27:
            continue
        score = np.concatenate([[0], np.cumsum(np.where(on, 1, -7))])
        at = np.nonzero(on)[0]
        for i in at:
            ends = at[at >= i + 29]
            if len(ends) and (score[ends + 1] - score[i]).max() >= 0:
                return True
    return False


def test_leaks_equal_all_diagonals(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    items = pd.read_parquet(f"{small}/eval_items.parquet")
    code: dict[str, int] = {}
    ids = lambda text: np.array([code.setdefault(w, len(code)) if w[0].isalnum() else -len(code) - 1 for w in contamination.plain_words(text)])
    passages = {i: ids(p) for i, p in zip(items.item_id, items.passage) if p}
    want = {(d, i) for d, t in zip(docs.doc_id, docs.text) if t for words in [ids(t)] for i, p in passages.items() if carried_on_one_diagonal(words, p)}
    got = {tuple(r) for r in p7_found(spark, small).collect()}
    assert want and want <= got
    assert len(got - want) <= 0.1 * len(got) + 1  # those that continue behind a page break or missing words
