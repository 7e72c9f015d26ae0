"""Toxicity by a learned lexicon, misspellings and context.

Learning, on at most ``FIT_ROWS`` labelled rows (chosen by a hash of the id): Spark counts, for every
word and word stem, the toxic and clean documents that hold it; terms whose toxic share can't be
chance make the lexicon (at most ``MOST_TERMS``); a logistic regression of a few
context features sets the score. Only the text is an input.

Scoring, over every whole text: a Levenshtein automaton for each new word runs along the
lexicon's trie and finds terms of five letters or more within one edit (stems as beginnings). A word that
matches with an edit but stands in clean learning rows is an exception. A term keeps its misspellings if its matches with an edit that are
no exceptions are toxic for the most part, by the rates of the learning rows. Around each hit a window of
words tells quotation (quotation marks, words of report) from abuse (address in the second person).

Defined results: null and empty texts have no hits and get the score of such texts; ids
that are null or repeat don't matter to a score, and rows with a null id are never learned from, and of an id that
repeats one row; without labels, or
without toxic ones, there are no terms and all texts get one low score; empty in, empty out; other columns
pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import bounded_batches, materialize

FIT_ROWS, MOST_TERMS, WINDOW, CACHE_WORDS = 8000, 400, 6, 300_000
STEM, LONGEST_STEM, FUZZY, LEAST_SHARE = 4, 12, 5, 0.5
MISSPELLED = 0.05  # misspellings that are expected for each toxic document that holds a term
WORD = re.compile(r"[^\W_]+")
#: Words that report what someone else said, and words that address the reader, in four languages.
REPORT = frozenset("said says say called calling wrote writes quoted quote quotes word term slur titled dit disait écrit mot sagte sagt schrieb wort genannt dijo dice escribió palabra".split())
ADDRESS = frozenset("you your youre yours u ur tu toi vous ton votre du dich dein ihr euch tú ti vosotros usted".split())
OPENING, CLOSING = "\"“«„‘", "\"”»“’"


class Levenshtein:
    """The automaton of the words within ``k`` edits of any word, run without
    that word's own table: a state is the set of (place, edits) still possible, places counted from the least;
    a step depends only on where the next letters of the word equal the read letter."""

    def __init__(self, k: int):
        self.k, self.memo = k, {}

    start = (0, ((0, 0),))

    def step(self, state: tuple, word: str, letter: str) -> tuple | None:
        base, places = state
        equal = tuple(word[base + d:base + d + 1] == letter for d in range(2 * self.k + 1 + self.k))
        left = min(len(word) - base, 3 * self.k + 2)
        key = (places, equal, left)
        if key not in self.memo:
            best: dict[int, int] = {}
            for p, e in places:
                moves = [(p, e + 1), (p + 1, e + 1)]  # a letter too many in the term; another letter
                # letters missing in the term, then an equal one
                moves += [(p + d + 1, e + d) for d in range(self.k - e + 1) if p + d < len(equal) and equal[p + d]]
                for q, f in moves:
                    if f <= self.k and q <= left and f < best.get(q, self.k + 1):
                        best[q] = f
            alive = sorted((q, f) for q, f in best.items() if not any(g < f and abs(q - r) <= f - g for r, g in best.items()))
            shift = alive[0][0] if alive else 0
            self.memo[key] = (shift, tuple((q - shift, f) for q, f in alive)) if alive else None
        found = self.memo[key]
        return None if found is None else (base + found[0], found[1])

    def edits(self, state: tuple, word: str) -> int:
        """Edits to accept here as a whole word; over k: none."""
        base, places = state
        return min((e + len(word) - base - p for p, e in places), default=self.k + 1)


class Trie:
    """The lexicon. A term is met exactly (a stem as the beginning of a word) by
    walking down the trie; terms that may be misspelled are a trie of their own, which the automaton of a
    word walks. One edit leaves the first or the second half of a term as it is, so words that
    begin and end like no half of a term skip that walk. ``near_stems`` does the same for stems."""

    def __init__(self, terms: dict[str, tuple[float, bool, bool]]):
        self.root, self.fuzzy, self.stems = {}, {}, {}
        self.stem_heads: dict[int, set[str]] = {}
        self.stem_tails: dict[tuple[int, int], set[str]] = {}
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        self.automaton = Levenshtein(1)
        for term, (weight, stem, fuzzy) in terms.items():
            roots = [self.root]
            half = len(term) // 2
            if fuzzy and stem and len(term) >= FUZZY:
                roots.append(self.stems)
                self.stem_heads.setdefault(half, set()).add(term[:half])
                for at in (half - 1, half, half + 1):  # where the second half stands after an edit in the first
                    self.stem_tails.setdefault((at, at + len(term) - half), set()).add(term[half:])
            elif fuzzy and len(term) >= FUZZY:
                roots.append(self.fuzzy)
                self.heads.setdefault(half, set()).add(term[:half])
                self.tails.setdefault(len(term) - half, set()).add(term[half:])
            for node in roots:
                for c in term:
                    node = node.setdefault(c, {})
                node[""] = (term, weight, stem)

    def matches(self, word: str) -> list[tuple[int, float, str]]:
        """(edits, -weight, term) of the terms that the word is, nearly is or (stems) begins with."""
        out, node, n = [], self.root, len(word)
        for k, c in enumerate(word, 1):
            node = node.get(c)
            if node is None:
                break
            if "" in node and (node[""][2] or k == n):
                out.append((0, -node[""][1], node[""][0]))
        if not (any(word[:k] in s for k, s in self.heads.items()) or any(word[-k:] in s for k, s in self.tails.items())):
            return out
        a, todo = self.automaton, [(self.fuzzy, self.automaton.start)]
        while todo:
            node, state = todo.pop()
            for c, below in node.items():
                if c == "":
                    if a.edits(state, word) == 1:
                        out.append((1, -below[1], below[0]))
                elif (after := a.step(state, word, c)) is not None:
                    todo.append((below, after))
        return out

    def near_stems(self, word: str) -> list[tuple[int, float, str]]:
        """(1, -weight, stem) of the stems that some beginning of the word is one edit from, and none is equal to."""
        out: list[tuple[int, float, str]] = []
        if not (any(word[:k] in s for k, s in self.stem_heads.items()) or any(word[a:b] in s for (a, b), s in self.stem_tails.items())):
            return out
        a, todo = self.automaton, [(self.stems, self.automaton.start)]
        while todo:
            node, state = todo.pop()
            for c, below in node.items():
                if c == "":
                    if min(e for _, e in state[1]) == 1:
                        out.append((1, -below[1], below[0]))
                elif (after := a.step(state, word, c)) is not None:
                    todo.append((below, after))
        return out


@dataclass
class Model:
    terms: dict[str, tuple[float, bool, bool]] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    trie: Trie | None = None
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.terms, self.exceptions, self.weights

    def __setstate__(self, state):
        self.terms, self.exceptions, self.weights = state
        self.trie, self.cache = None, {}

    def hit(self, word: str) -> tuple[int, float, str] | None:
        """The best match of a word: fewest edits, then the greatest weight."""
        if self.trie is None:
            self.trie = Trie(self.terms)
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        found = self.trie.matches(word) if len(word) >= 3 else []
        if len(word) >= 3 and not any(e == 0 for e, _, _ in found):
            found = found + self.trie.near_stems(word)
        best = min(found) if found else None
        if best and best[0] and word in self.exceptions:
            best = None
        if len(word) <= 40:
            self.cache[word] = best
        return best

    def hits(self, text: str) -> list[tuple[int, int, float, str]]:
        """(word number, edits, weight, term) of each hit in a text."""
        out, cache = [], self.cache
        for i, w in enumerate(WORD.findall(text.lower())):
            try:
                h = cache[w]
            except KeyError:
                h = self.hit(w)
            if h:
                out.append((i, h[0], -h[1], h[2]))
        return out

    def features(self, text: str) -> tuple[float, ...]:
        """meant (not quoted), misspelled, quoted and addressed weight, and their density."""
        found = self.hits(text) if self.terms else []
        if not found:
            return 0.0, 0.0, 0.0, 0.0, 0.0
        low = text.lower()
        spans = [m.span() for m in WORD.finditer(low)]
        meant = fuzzy = quoted = address = 0.0
        for i, edits, weight, _ in found:
            near = {low[a:b] for a, b in spans[max(0, i - WINDOW):i + WINDOW + 1]}
            a, b = spans[i]
            lo, hi = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
            marked = any(c in OPENING for c in low[lo:a]) and any(c in CLOSING for c in low[b:hi])
            if not near & ADDRESS and (marked or near & REPORT and any(c in OPENING for c in low[lo:a])):
                quoted += weight
            else:
                meant += weight
                fuzzy += weight * (edits > 0)
            address += weight * bool(near & ADDRESS)
        total = meant + quoted
        return tuple(math.log1p(x) for x in (meant, fuzzy, quoted, address)) + (total / (total + len(spans)),)

    def score(self, text: str) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights (intercept first) by Newton's method, with a small ridge; the weights
    of what is meant and addressed may not be negative."""
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    held = np.zeros(len(w), bool)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        g = a.T @ (p - y) + ridge * np.r_[0, w[1:]]
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        g[held], h[held], h[:, held] = 0, 0, 0
        h[held, held] = 1
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        for k in (1, 4):
            if w[k] < 0:
                w[k], held[k] = 0.0, True
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
           .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
           .orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    # at most fit_rows small rows
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").where("text is not null")
    # an id that repeats is one example: the text of least hash
    d = d.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    d = materialize(d, "toxicity-fit")
    n, bad = d.agg(F.count("*"), F.sum("y")).first()
    bad = bad or 0
    if not bad or bad == n:
        return Model()
    word = F.expr(r"array_distinct(filter(split(lower(text), '[^\\p{L}\\p{N}]+'), w -> length(w) >= 3))")
    terms = (d.select("y", word.alias("w"))
             .select("y", F.explode(F.expr(f"""array_distinct(concat(transform(w, x -> concat(x, '$')),
                 flatten(transform(filter(w, x -> length(x) >= {STEM}), x -> transform(sequence({STEM}, least(length(x), {LONGEST_STEM})), k -> substring(x, 1, k))))))""")).alias("t"))
             .groupBy("t").agg(F.sum("y").alias("a"), F.count("*").alias("c")))
    n_terms = terms.count()
    # the chance of so many toxic documents among c, if the term told nothing, times the terms tried
    share, base = F.col("a") / F.col("c"), bad / n
    gain = F.col("a") * (F.log(share / base) + F.when(share < 1, (F.col("c") / F.col("a") - 1) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    good = (terms.where((F.col("a") >= 3) & (share >= LEAST_SHARE)).withColumn("gain", gain).where(F.col("gain") > math.log(n_terms) + 2)
            .orderBy(F.desc("gain"), "t").limit(20 * MOST_TERMS).collect())
    found = {r.t: (r.a, r.c) for r in good}
    weight = lambda a, c: math.log((a + 0.5) / (bad + 1)) - math.log((c - a + 0.5) / (n - bad + 1))
    lexicon: dict[str, tuple[float, bool, bool]] = {}
    for t, (a, c) in found.items():
        stem = not t.endswith("$")
        name = t.rstrip("$")
        heads = [found[name[:k]] for k in range(STEM, len(name) + (0 if stem else 1)) if name[:k] in found]
        if any(h[0] > a and h[0] / h[1] > a / c - 0.05 for h in heads):
            continue  # a shorter stem says as much for more documents
        if stem and any(found.get(name + x, (0, 0))[0] == a for x in {o[len(name):len(name) + 1] for o in found if len(o) > len(name) and o.startswith(name)}):
            continue  # a longer one, or the whole word, for the same
        if len(lexicon) < MOST_TERMS:
            lexicon[name] = (weight(a, c), stem, True)
    model = Model(terms=lexicon)

    @F.arrow_udf("array<string>")
    def near(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            words = WORD.findall((t or "").lower())
            out.append(sorted({f"{term} {words[i]}" for i, e, _, term in model.hits(t or "") if e}))
        return pa.array(out, pa.list_(pa.string()))

    # misspelled matches in learning rows: at most the words of these rows, with the clean and the toxic documents that hold them
    hits = (d.select("y", F.explode(near("text")).alias("w")).groupBy("w").agg(F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic")).collect())
    exceptions = frozenset(r.w.split(" ")[1] for r in hits if r.clean)
    # words that only one clean document holds are as many as a clean document would bring new ones; misspellings
    # in toxic documents are those found there, and a share of the term's own hits. All grow with the rows alike
    meant, chance = Counter(), Counter()
    for r in hits:
        term, near_word = r.w.split(" ")
        meant[term] += r.toxic if near_word not in exceptions else 0
        chance[term] += r.clean == 1
    for t, (w, stem, _) in lexicon.items():
        of = meant[t] + MISSPELLED * found[t if stem else t + "$"][0]
        lexicon[t] = (w, stem, of >= LEAST_SHARE * (of + chance[t]))
    model = Model(terms=lexicon, exceptions=exceptions)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([list(model.features(t or "")) for t in texts.to_pylist()], pa.list_(pa.float64()))

    rows = d.select("id", "y", features("text").alias("x")).collect()  # at most fit_rows rows of five numbers
    rows.sort(key=lambda r: r.id)
    weights = logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))
    return Model(terms=lexicon, exceptions=exceptions, weights=weights)


def score_column(model: Model, text: str | Column = "text") -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t or "") for t in texts.to_pylist()], pa.float64())

    return score(F.col(text) if isinstance(text, str) else text)
