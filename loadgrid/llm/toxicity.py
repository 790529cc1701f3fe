"""Toxicity by noisy-channel deobfuscation.

Writers hide words by look-alike signs (1d10t), spacing (i d i o t) and repetition (idiooot). Every suspicious token is a
lattice: each sign may stand for itself, for letters that it looks like, or for nothing, at a cost. The Viterbi path
under a character trigram model of the whole corpus is the restored word. Restored texts are then scored: words and
word beginnings that labelled texts show to go with toxicity are evidence, weighed by a logistic regression.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadgrid.llm.quality import fold
from loadgrid.operators.tables import written

#: What a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}
#: Signs that may stand between the letters of a word.
GAPS = ".-_*~'^,/\\ "
LOOK_COST, DROP_COST, GAP_COST, REPEAT_COST = 1.0, 3.0, 0.5, 0.5
#: Labelled rows that the regression is fitted on at most; counts of evidence cover all of them.
FIT_ROWS = 50_000
#: Labels are sent to all executors up to this many, else joined by a shuffle.
FEW_LABELS = 2_000_000
#: Signs without any meaning that are expected to be taken as evidence by chance, over all together, at most.
ERROR = 1.0
#: Evidence is sent to all tasks up to this many signs, else joined by a shuffle.
FEW_SIGNS = 200_000
RIDGE = 0.3
BEGINNINGS, WHOLE = (3, 4, 5, 6, 7, 8), 10
SYMBOLS = 28  # 0: no letter, 1 to 26: a to z, 27: any other letter
#: Tokens whose signs a task remembers, and signs that it counts before it hands them on: bounds of its memory.
MEMO, MEMO_LETTERS, COUNTED = 100_000, 100, 250_000
MARK = "\0"
#: Rows whose texts a task holds as Python objects at a time.
ROWS = 500

_SUSPICIOUS = re.compile(r"[^\W\d_][0-9@$!|+(<€£¥.\-_*~'^,/\\]+[^\W_]|[0-9@$!|+(<€£¥][^\W\d_]|([^\W\d_])\1\1")
_LOOKING = re.compile(r"[0-9@$!|+(<€£¥]")
_SPACED = re.compile(r"(?<!\S)(?:\S[ .\-_*]){2,}\S(?!\w)")
_REPEATED = re.compile(r"(.)\1{3,}", re.DOTALL)
_RUN = re.compile(r"[^\W\d_]+")


def _parts(batches):
    """The batches in slices of ROWS."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _symbol(c: int) -> int:
    if 97 <= c <= 122:
        return c - 96
    return 27 if chr(c).isalpha() else 0


#: Symbols of code points below U+0250; those above count as other letters.
_TABLE = np.array([_symbol(c) for c in range(0x250)] + [27], np.int64)


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, 0x250)]


def _count_trigrams(batches):
    total = np.zeros(SYMBOLS**3, np.int64)
    for b in _parts(batches):
        for text in b.column(0).to_pylist():
            s = np.concatenate([[0, 0], symbols(text or ""), [0]])
            total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a symbol after two others, from all texts, smoothed by those after one."""
    grams = docs.select(F.col(text_col).cast("string")).mapInArrow(_count_trigrams, "gram long, n long")
    n = np.zeros(SYMBOLS**3)
    for row in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most SYMBOLS**3 rows
        n[row["gram"]] = row["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = n.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    return np.log((n + 2 * two) / (n.sum(2, keepdims=True) + 2))


def _marked(token: str, model: list) -> list[str]:
    """As restore(), with a MARK where a gap was."""
    # a word is a chain (rest, last letter), so that a long token takes no copies
    paths: dict = {(0, 0): (0.0, None)}
    for i, c in enumerate(token):
        ways: list[tuple[str, float]] = []
        if c.isalpha():
            ways.append((c, 0.0))
            same = i > 0 and token[i - 1] == c and (token[i - 2 : i - 1] == c or token[i + 1 : i + 2] == c)
            if same:
                ways.append(("", REPEAT_COST))
        elif c in GAPS:
            paths = {state: (score - GAP_COST, (word, MARK)) for state, (score, word) in paths.items()}
            continue
        else:
            ways += [(x, LOOK_COST) for x in LOOKS.get(c, "")]
            repeated = i > 0 and token[i - 1] == c
            ways.append(("", REPEAT_COST if repeated else DROP_COST))
        after: dict = {}
        for (a, b), (score, word) in paths.items():
            for letter, cost in ways:
                if letter:
                    s = _symbol(ord(letter))
                    state, value, text = (b, s), score - cost + model[a][b][s], (word, letter)
                else:
                    state, value, text = (a, b), score - cost, word
                if state not in after or value > after[state][0]:
                    after[state] = (value, text)
        paths = after
    ends = sorted(((score + model[a][b][0], chain) for (a, b), (score, chain) in paths.items()), key=lambda e: e[0], reverse=True)
    words = []
    for score, chain in ends[:3]:
        letters = []
        while chain is not None:
            chain, letter = chain
            letters.append(letter)
        words.append((score, "".join(reversed(letters))))
    return [word for _, word in sorted(words, reverse=True) if word.strip(MARK)]


def restore(token: str, model: list) -> list[str]:
    """Words that a lower-case token may hide, best first: the best Viterbi path for each of the last letters."""
    return [word.replace(MARK, "") for word in _marked(token, model)]


def signs(word: str) -> list[str]:
    """What of a word may be evidence: short words, and the beginnings of longer ones, which take endings."""
    n = len(word)
    found = [f"^{word[:k]}" for k in BEGINNINGS if n > k]
    if 3 <= n <= WHOLE:
        found.append(f"={word}")
    return found


def inner_signs(marked: str, anywhere: bool):
    """Signs of the words that a restored text may hold: they start and end where a gap was, or start anywhere."""
    parts = marked.split(MARK)
    text = "".join(parts)
    n, edges = len(text), [0, *np.cumsum([len(p) for p in parts]).tolist()]
    cuts = sorted(set(edges))
    first = 0
    for start in range(n) if anywhere else cuts[:-1]:
        for k in BEGINNINGS:
            if start + k < n:
                yield f"^{text[start : start + k]}"
        while first < len(cuts) and cuts[first] < start + 3:
            first += 1
        for end in cuts[first : first + WHOLE]:
            if end > start + WHOLE:
                break
            yield f"={text[start:end]}"


class Signs(dict):
    """Signs of a token and of what it may hide; only those in the vocabulary, as numbers, if there is one."""

    def __init__(self, model: list, vocabulary: dict | None = None):
        self.model, self.vocabulary = model, vocabulary

    def __missing__(self, token: str) -> tuple:
        found = set()
        for run in _RUN.findall(token):
            found.update(signs(run))
        if _SUSPICIOUS.search(token):
            found.update(self._hidden(token, bool(_LOOKING.search(token))))
        if self.vocabulary is not None:
            found = {self.vocabulary[x] for x in found if x in self.vocabulary}
        out = tuple(found)
        if len(token) <= MEMO_LETTERS:
            if len(self) >= MEMO:
                self.clear()
            self[token] = out
        return out

    def _hidden(self, token: str, anywhere: bool):
        """Signs of what a token may hide; of a vocabulary, only those in it."""
        for word in _marked(_REPEATED.sub(r"\1\1\1", token), self.model):
            for x in inner_signs(word, anywhere):
                if self.vocabulary is None or x in self.vocabulary:
                    yield x

    def of(self, text: str) -> set:
        """Signs of a whole text."""
        text = text.lower()
        found = set()
        for token in set(text.split()):
            found.update(self[token])
        for spaced in _SPACED.finditer(text):
            # every second sign is a gap; between all letters a word may start or end
            for x in self._hidden(spaced.group(), True):
                found.add(x if self.vocabulary is None else self.vocabulary[x])
        return found


def _count_signs(model: list):
    """(sign, n, toxic): labelled texts with each sign, and toxic ones among them, summed within a task."""

    def out(n: Counter, t: Counter):
        keys = list(n)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[k] for k in part], pa.int64()), pa.array([t[k] for k in part], pa.int64())], names=["sign", "n", "toxic"])

    def run(batches):
        signs_, n, t = Signs(model), Counter(), Counter()
        for b in _parts(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = signs_.of(text or "")
                n.update(own)
                if label:
                    t.update(own)
                if len(n) > COUNTED:
                    yield from out(n, t)
                    n, t = Counter(), Counter()
        yield from out(n, t)

    return run


def _hits(model: list, vocabulary: dict):
    def run(batches):
        signs_ = Signs(model, vocabulary)
        for b in _parts(batches):
            rows = [sorted(signs_.of(text or "")) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["id", "hits"])

    return run


def _listed(model: list):
    """(row, signs) of (row, text): all signs of each text."""

    def run(batches):
        signs_ = Signs(model)
        for b in _parts(batches):
            rows = [sorted(signs_.of(text or "")) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.string()))], names=["row", "signs"])

    return run


def evidence(counts: DataFrame, rows: int, toxic: int, error: float = ERROR) -> DataFrame:
    """(sign, strength): signs that go with toxicity by more than chance.

    A sign in n texts of which t are toxic is kept if a share so far above the base rate has a probability below error
    over all signs (Chernoff bound), however many there are.
    """
    total = counts.count()
    if not total or not toxic or toxic == rows:
        return counts.select("sign", F.lit(0.0).alias("strength")).where("false")
    base = toxic / rows
    share = F.col("toxic") / F.col("n")
    clean = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    strength = F.col("n") * (share * F.log(share / base) + clean)
    found = counts.where("toxic > 0").where(share > base).withColumn("strength", strength)
    return found.where(F.col("strength") > float(np.log(total / error))).select("sign", "strength")


def _numbered_hits(texts: DataFrame, known: DataFrame, kept: DataFrame, model: list) -> tuple[DataFrame, dict]:
    """(id, hits, label) of labelled texts, hits being numbers of signs that are kept, and these numbers.

    Where kept is too large to be sent, only its signs that occur in these texts have numbers; others would get no weight.
    """
    rows = texts.join(F.broadcast(known), "id")
    if kept.count() <= FEW_SIGNS:
        vocabulary = {r["sign"]: i for i, r in enumerate(kept.orderBy(F.desc("strength"), "sign").collect())}
        return rows.select("id", "text").mapInArrow(_hits(model, vocabulary), "id long, hits array<int>").join(known, "id"), vocabulary
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    own = rows.select("row", "text").mapInArrow(_listed(model), "row long, signs array<string>")
    own = written(own.select("row", F.explode("signs").alias("sign")).join(kept.select("sign"), "sign"))
    vocabulary = {r["sign"]: i for i, r in enumerate(own.select("sign").distinct().orderBy("sign").collect())}
    schema = "sign string, number int"
    numbers = texts.sparkSession.createDataFrame(pa.table({"sign": pa.array(vocabulary, pa.string()), "number": pa.array(vocabulary.values(), pa.int32())}), schema)
    lists = own.join(numbers, "sign").groupBy("row").agg(F.array_sort(F.collect_list("number")).alias("hits"))
    return rows.join(lists, "row", "left").select("id", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), "label"), vocabulary


def fit(row: np.ndarray, col: np.ndarray, labels: np.ndarray, size: int, ridge: float = RIDGE, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and offset of a ridge logistic regression on sets of hits (row, col), by accelerated full-batch gradient steps."""
    y = labels.astype(np.float64)
    w, offset = np.zeros(size), 0.0
    if not len(y):
        return w, offset
    base = (y.sum() + 0.5) / (len(y) + 1)
    offset = float(np.log(base / (1 - base)))
    most = np.bincount(row, minlength=len(y)).max(initial=0) + 1
    each = np.bincount(col, minlength=size) + 1.0
    # Adam-free: per-coordinate step from a bound of the curvature
    step = 1 / (0.25 * each * most + ridge)
    v, last_w = w.copy(), w.copy()
    o, last_o = offset, offset
    for k in range(1, steps + 1):
        z = np.bincount(row, v[col], minlength=len(y)) + o
        g = 1 / (1 + np.exp(-z)) - y
        w = v - step * (np.bincount(col, g[row], minlength=size) + ridge * v)
        offset = o - g.sum() / (0.25 * len(y) * most)
        pull = (k - 1) / (k + 2)
        v, o = w + pull * (w - last_w), offset + pull * (offset - last_o)
        last_w, last_o = w, offset
    return w, float(offset)


def _scores(model: list, vocabulary: dict, weights: np.ndarray, offset: float):
    def run(batches):
        signs_ = Signs(model, vocabulary)
        for b in _parts(batches):
            z = np.array([offset + sum(weights[h] for h in signs_.of(text or "")) for text in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["id", "score"])

    return run


def train(docs: DataFrame, known: DataFrame, text_col: str = "text", id_col: str = "doc_id"):
    """What scoring needs, from all texts and the labels known (id, label) of some: model, vocabulary, weights, offset."""
    model = character_model(docs, text_col).tolist()
    known = written(known.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label")))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    near = F.broadcast(known) if n <= FEW_LABELS else known
    counts = texts.join(near, "id").select("text", "label").mapInArrow(_count_signs(model), "sign string, n long, toxic long")
    counts = written(counts.groupBy("sign").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")))
    kept = written(evidence(counts, n, toxic))
    few = known if n <= FIT_ROWS else known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(FIT_ROWS / n * (1 << 20)))
    fitted, vocabulary = _numbered_hits(texts, few, kept, model)
    rows = fitted.select("id", "hits", "label").toArrow().sort_by([("id", "ascending"), ("label", "ascending")]).combine_chunks()  # about FIT_ROWS
    hits = rows["hits"].combine_chunks()
    sizes = hits.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    col = hits.flatten().to_numpy(zero_copy_only=False)
    weights, offset = fit(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), col, rows["label"].to_numpy(), len(vocabulary))
    return model, vocabulary, weights, offset


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted.

    Rows whose fold is held are not learned from. Labels other than 0 and 1, null ids and labels without a document are
    ignored; an id that labels repeats counts with its largest label. A null text is scored as an empty one. Rows with a
    null id are scored, not held out. Without any label every score is 0.5. Other columns have no effect. An empty
    table gives an empty result.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("label"))
    model = train(docs, known.where(fold(F.col("id"), folds) != held), text_col, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(*model), "id long, score double")
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0, most: float = 0.5) -> DataFrame:
    """docs without the rows whose score is most or more; columns and other rows stay as they are.

    Null texts, ids and labels, repeated rows and empty tables are taken as in classify(). Without any label all scores
    are 0.5.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("label"))
    model, vocabulary, weights, offset = train(docs, known.where(fold(F.col("id"), folds) != held), text_col, id_col)
    at = docs.columns.index(text_col)

    def keep(batches):
        signs_ = Signs(model, vocabulary)
        least = np.log(most / (1 - most))
        for b in _parts(batches):
            clean = [offset + sum(weights[h] for h in signs_.of(text or "")) < least for text in b.column(at).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
