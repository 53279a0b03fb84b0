"""License scan: an exact set-similarity join of text blocks with license templates, and fixed phrases."""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import portions, table

# The phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences by which texts state their license, and labels for them.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("gpl-notice", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "this program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mpl", "this source code form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
#: Least share of a template's words that a block holds.
LEAST = 0.9
#: Texts read at once: so many bytes, or one longer text.
_BYTES = 4_000_000
_SCAN = "n_words long, places array<struct<label: string, word: long>>, blocks array<struct<label: string, word: long, share: double>>"
# Bytes of words, A-Z as a-z; every other byte is zero.
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _first, _last, _to in (("0", "9", "0"), ("a", "z", "a"), ("A", "Z", "a")):
    _FOLD[ord(_first) : ord(_last) + 1] = np.arange(ord(_last) - ord(_first) + 1) + ord(_to)


def words_of(text: str) -> list[str]:
    """The words of a text, by the same bytes as in ``Words``."""
    return bytes(_FOLD[np.frombuffer(text.encode(), np.uint8)]).replace(b"\0", b" ").decode().split()


class Words:
    """Finds a fixed set of words in texts, byte by byte and exactly."""

    def __init__(self, words: Sequence[str]):
        self.words = list(words)
        raw = [w.encode() for w in self.words]
        self.longest = max(map(len, raw))
        order = np.argsort(np.array(raw, f"S{self.longest}"))
        self.sorted, self.number = np.array(raw, f"S{self.longest}")[order], order
        self.ends = np.zeros((self.longest + 1) << 16, bool)  # by length, first and last byte
        for w in raw:
            self.ends[len(w) << 16 | w[0] << 8 | w[-1]] = True

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each text; and of each word in the set: its text, place in the text and number in the set."""
        folded = np.concatenate([np.zeros(1, np.uint8), _FOLD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]])
        edge = np.diff((folded > 0).view(np.int8))
        start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        bounds = np.cumsum([len(t) + 1 for t in texts]) + 1
        upto = np.searchsorted(start, bounds)
        size = end - start
        some = np.flatnonzero(size <= self.longest)
        some = some[self.ends[size[some] << 16 | folded[start[some]].astype(np.int64) << 8 | folded[end[some] - 1]]]
        column = np.arange(self.longest)[None, :]
        found, which = [], []
        for k in range(0, len(some), 100_000):
            at = some[k : k + 100_000]
            cells = np.where(column < size[at][:, None], folded[np.minimum(start[at][:, None] + column, len(folded) - 1)], 0)
            word = np.ascontiguousarray(cells.astype(np.uint8)).view(f"S{self.longest}").ravel()
            near = np.minimum(np.searchsorted(self.sorted, word), len(self.sorted) - 1)
            real = self.sorted[near] == word
            found.append(at[real])
            which.append(self.number[near[real]])
        found, which = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, which))
        text = np.searchsorted(upto, found, side="right")
        first = np.concatenate([[0], upto[:-1]])
        return np.diff(np.concatenate([[0], upto])), text, found - first[text], which


def word_counts(docs: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """How often each of some words stands in all texts: counted in tasks, at most ``len(words)`` rows come back."""

    def count(batches):
        find, total = Words(words), np.zeros(len(words), np.int64)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in portions(texts, _BYTES):
                total += np.bincount(find.find(texts[part])[3], minlength=len(words))
        yield pd.DataFrame({"word": np.arange(len(words)), "n": total})

    rows = docs.select(F.col("text").cast("binary").alias("text")).dropna().mapInPandas(count, "word int, n long")
    found = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(i, 0) for i, w in enumerate(words)}


class Templates:
    """Template word sets in global frequency order, rarest word first, with an index of their prefixes by word."""

    def __init__(self, templates: Sequence[tuple[str, str]], order: Sequence[str], least: float):
        rank = {w: i for i, w in enumerate(order)}
        self.sets = [np.array(sorted({rank[w] for w in words_of(text)}), np.int64) for _, text in templates]
        self.need = np.array([-(-round(least * 1000) * len(s) // 1000) for s in self.sets])
        lengths = [len(words_of(text)) for _, text in templates]
        self.classes: dict[int, list[int]] = {}
        for t, n in enumerate(lengths):
            self.classes.setdefault(max(8, 1 << (n - 1).bit_length()), []).append(t)

    def matches(self, size: np.ndarray, text: np.ndarray, at: np.ndarray, word: np.ndarray):
        """``(text, template, first word of the block, share)`` of every block that holds enough of a template.

        A block of class L is ``2 * L`` words long and starts at a multiple of L, so that any L words in a row lie in one. Words that
        are in no template cannot add to an overlap; blocks are listed by the others.
        """
        for width, members in self.classes.items():
            last = at // width
            block = np.concatenate([last, last[last > 0] - 1])
            key = np.concatenate([text, text[last > 0]]) * (int(size.max(initial=0)) // width + 1) + block
            entry = np.unique(np.stack([key, np.concatenate([word, word[last > 0]])], axis=1), axis=0)
            if not len(entry):
                continue
            key, token = entry[:, 0], entry[:, 1]
            blocks, first, held = np.unique(key, return_index=True, return_counts=True)
            owner = np.repeat(np.arange(len(blocks)), held)
            place = np.arange(len(key)) - first[owner]  # of a token in its block, rarest first
            for t in members:
                words, need = self.sets[t], self.need[t]
                position = np.full(int(token.max()) + 2, -1)
                prefix = words[: len(words) - need + 1]
                prefix = prefix[prefix <= token.max()]
                position[prefix] = np.arange(len(prefix))
                i = position[token]
                # prefix and position: what stands before the first common word is lost; length: a block has enough words
                open_ = (i >= 0) & (held[owner] >= need) & (np.minimum(len(words) - i, held[owner] - place) >= need)
                ask = np.unique(owner[open_])
                inside = np.isin(owner, ask) & np.isin(token, words)
                common = np.bincount(owner[inside], minlength=len(blocks))
                ok = ask[common[ask] >= need]
                at_block = blocks[ok] % (int(size.max()) // width + 1)
                yield blocks[ok] // (int(size.max()) // width + 1), np.full(len(ok), t), at_block * width, common[ok] / len(words)


def license_scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST,
) -> DataFrame:
    """``docs`` with ``scan``: ``n_words, places array<struct<label, word>>, blocks array<struct<label, word, share>>``.

    ``places`` are where a phrase's words stand one after the other. ``blocks`` are the text blocks whose set of words holds at least
    ``least`` of a template's set: a block is twice as long as templates of its class (a power of two from 8) and starts at every multiple of
    the class. Null texts are empty; empty texts have no words. Every row is scanned on its own, so repeated rows get equal results;
    other columns stay as they are, and a column named ``scan`` is replaced. An empty table gives none.

    Templates and phrases are a parameter of bounded size. Their words are ordered by how often they stand in all texts.
    """
    templates, phrases = list(templates), {" ".join(words_of(p)): label for p, label in phrases.items()}
    own = sorted({w for _, text in templates for w in words_of(text)} | {w for p in phrases for w in p.split()})
    counts = word_counts(docs, own)
    order = sorted(own, key=lambda w: (counts[w], w))

    @F.pandas_udf(_SCAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find, index = Words(order), Templates(templates, order, least)
        rank = {w: i for i, w in enumerate(order)}
        for column in batches:
            texts = [t or b"" for t in column]
            out = []
            for part in portions(texts, _BYTES):
                size, text, at, word = find.find(texts[part])
                places, blocks = ([[] for _ in size] for _ in range(2))
                for phrase, label in phrases.items():
                    ids = [rank[w] for w in phrase.split()]
                    hit = np.arange(max(0, len(word) - len(ids) + 1))
                    for j, i in enumerate(ids):
                        hit = hit[(word[hit + j] == i) & (text[hit + j] == text[hit]) & (at[hit + j] == at[hit] + j)]
                    for k in hit:
                        places[text[k]].append({"label": label, "word": int(at[k])})
                for found in index.matches(size, text, at, word):
                    for d, t, w, share in zip(*(x.tolist() for x in found)):
                        blocks[d].append({"label": templates[t][0], "word": w, "share": share})
                out.append(pd.DataFrame({"n_words": size, "places": places, "blocks": blocks}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"n_words": [], "places": [], "blocks": []})

    return docs.withColumn("scan", scan(F.col("text").cast("binary")))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "scan.*")
    places, labels = F.transform("places", lambda p: p["word"]), F.transform("places", lambda p: p["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, F.transform("blocks", lambda b: b["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))).alias("score"),
        "blocks",
    )
