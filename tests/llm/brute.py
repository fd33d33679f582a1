"""Plain versions of the corpus operators for small tables: rows are (doc_id, text)."""

from __future__ import annotations

import collections
import hashlib
import os
import re

import numpy as np

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    found = words(text)
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def near_duplicates(rows, threshold=0.8):
    """doc_id -> (class, links, links to other texts), for distinct ids."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    links, texts = collections.Counter(), collections.Counter()
    seen_texts = [set() for _ in rows]

    def root(a):
        while group[a] != a:
            a = group[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) / len(a | b) >= threshold:
                links[i] += 1
                links[j] += 1
                if words(rows[i][1]) != words(rows[j][1]):
                    seen_texts[i].add(tuple(words(rows[j][1])))
                    seen_texts[j].add(tuple(words(rows[i][1])))
                low, high = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                group[high] = low
    return {rows[i][0]: (rows[root(i)][0], links[i], len(seen_texts[i])) for i in range(len(rows))}


def kept_words(rows, window=50):
    least = {}
    for doc_id, text in rows:
        found = words(text)
        for k in range(len(found) - window + 1):
            gram = tuple(found[k : k + window])
            if doc_id is not None:
                least[gram] = min(least.get(gram, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        found = words(text)
        gone = [False] * len(found)
        for k in range(len(found) - window + 1):
            if doc_id is not None and least[tuple(found[k : k + window])] < doc_id:
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(found, gone) if not g)
        out.append((doc_id, len(found), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def kept_bytes(rows, window=400):
    count = collections.Counter()
    for _, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - window + 1):
            count[raw[k : k + window]] += 1
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - window + 1):
            if count[raw[k : k + window]] > 1:
                gone[k : k + window] = True
        runs = int((gone & ~np.append([False], gone[:-1])).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def tokenizer(path):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found
