"""Problem 10: per-document text statistics, and a Gaussian mixture over them that tells prose from lists, tables and junk."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

STATISTICS = (
    "n_chars", "n_lines", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_share",
    "words_per_line", "sentence_rate", "distinct_share", "cell_lines", "marked_lines", "short_lines", "wordlike_share", "capital_share",
)
SCHEMA = "doc_id bigint, " + ", ".join(f"{s} double" for s in STATISTICS)
#: Statistics the mixture sees, after the transforms in ``_features``.
FEATURES = ("mean_word_length", "symbol_ratio", "digit_ratio", "common_share", "words_per_line", "sentence_rate", "distinct_share", "cell_lines", "marked_lines", "short_lines", "wordlike_share", "capital_share")
#: Components of the mixture; rounds of expectation-maximization; ridge on the covariances; rows that a component's first
#: round covariance weighs, so that a component of few rows keeps one.
COMPONENTS, ROUNDS, RIDGE, PRIOR, FIRST = 48, 12, 0.05, 2.0, 0.3
#: Rows, those of the least hash of their id, among which the first centres are chosen far from one another.
SEED_ROWS = 4_000

_ALNUM_SPACE = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b" \t\n\r" + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_CELLS = re.compile(r"[|;\t]|,(?=\S)| {3,}|\.{4,}")
_MARK = re.compile(r"\s*(?:[-*+•◦–▪·‣]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")
_SENTENCE = re.compile(r"[.!?…][\"'”»)]*(?:\s|$)")
_WORDLIKE = re.compile(r"[«“(¿¡\"'*_]*[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?…»”)\"'*_]*")
_VOWEL = re.compile(r"[aeiouyàáâãäåèéêëìíîïòóôõöùúûü]", re.I)
_RUN = re.compile(r"[^aeiouyàáâãäåèéêëìíîïòóôõöùúûü\W\d_]{5,}", re.I)
_STRIP = ".,;:!?…\"'’“”«»()[]*_¿¡-–"


def statistics(text: str | None, common: frozenset[str]) -> tuple[float, ...]:
    """The values of STATISTICS for one text; zeros for null or blank text. The whole text is read."""
    text = text or ""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    words = text.split()
    n, w = len(lines), len(words)
    if not w:
        return (float(len(text)), float(n), *[0.0] * (len(STATISTICS) - 2))
    raw = text.encode("utf-8", "replace")
    distinct: dict[str, int] = {}
    for x in words:
        distinct[x] = distinct.get(x, 0) + 1
    commons = wordlike = caps = 0
    folded: set[str] = set()
    for x, k in distinct.items():
        y = x.strip(_STRIP).lower()
        folded.add(y)
        if y in common:
            commons += k
            wordlike += k
        elif _WORDLIKE.fullmatch(x) and len(x) <= 24 and _VOWEL.search(y) and not _RUN.search(y):
            wordlike += k
        if x[:1].isupper():
            caps += k
    cell = marked = short = ended = 0
    for x in lines:
        k = x.count(" ") + 1
        if k <= 7:
            short += 1
        if _MARK.match(x):
            marked += 1
        s = len(_CELLS.findall(x))
        if s >= 2 and s * 9 >= min(k, 60):
            cell += 1
        if x.rstrip()[-1] in ".!?…”»\"":
            ended += 1
    nonspace = sum(map(len, words))
    return (
        float(len(text)), float(n), float(w), nonspace / w, len(raw.translate(None, _ALNUM_SPACE)) / max(1, len(raw)), (len(raw) - len(raw.translate(None, _DIGITS))) / max(1, len(raw)),
        ended / n, commons / w, w / n, len(_SENTENCE.findall(text)) / w, len(folded) / w, cell / n, marked / n, short / n, wordlike / w, caps / w,
    )


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row of STATISTICS per document, over the whole text. ``common_words`` is a fixed list of at most some thousands."""
    common = frozenset(r.word.lower() for r in common_words.select("word").collect() if r.word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t, common) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.float64()) for c in cols]], names=["doc_id", *STATISTICS])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _features(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Skewed statistics on a root or log scale."""
    x = {k: np.asarray(columns[k], float) for k in FEATURES}
    x["mean_word_length"] = np.log(np.maximum(x["mean_word_length"], 1))
    x["words_per_line"] = np.log(np.maximum(x["words_per_line"], 0.5))
    x["symbol_ratio"], x["digit_ratio"], x["sentence_rate"] = (np.sqrt(x[k]) for k in ("symbol_ratio", "digit_ratio", "sentence_rate"))
    return np.column_stack([x[k] for k in FEATURES]) if len(next(iter(x.values()))) else np.zeros((0, len(FEATURES)))


def examples() -> list[tuple[str, str]]:
    """(kind, text) of general forms of prose, lists, tables and junk. They name the components that were learned from the
    documents and have no part in learning them."""
    noun = "old bridge;the tea garden;la casa azul;le petit marché;o barco novo;der hohe Turm;il vecchio forno;la mesa redonda;green paint;el reloj".split(";")
    place = "Oslo Lima Quito Turin Porto Lyon Graz Cork".split()
    first = "Anna Bruno Clara David Elena Franz Greta Hugo Irene Jonas".split()
    last = "Keller Lopes Martin Novak Ortega Prior Quint Rossi Silva Thorn".split()
    people = [f"{first[i % 10]} {last[(i * 3 + i // 10) % 10]}" for i in range(40)]
    sentences = (
        "La biblioteca abre sus puertas a las nueve de la mañana y, aunque el horario ha cambiado, los lectores no se han quejado. Durante el verano de 2003 llegaron 120 visitantes cada día, casi el doble que antes.",
        "The library opens its doors at nine in the morning and, although the hours have changed, the readers have not complained. During the summer of 2003 there were 120 visitors a day, nearly twice as many as before.",
        "La bibliothèque ouvre ses portes à neuf heures et, même si les horaires ont changé, les lecteurs ne se sont pas plaints. Pendant l'été 2003, elle a reçu 120 visiteurs par jour, presque deux fois plus qu'avant.",
        "Die Bibliothek öffnet um neun Uhr, und obwohl sich die Zeiten geändert haben, hat sich von den Lesern niemand beschwert. Im Sommer 2003 kamen 120 Besucher am Tag, fast doppelt so viele wie im Jahr davor.",
        "La biblioteca apre alle nove del mattino e, anche se gli orari sono cambiati, i lettori non si sono lamentati. Durante l'estate del 2003 sono arrivati 120 visitatori al giorno, quasi il doppio di prima.",
        "A biblioteca abre as portas às nove da manhã e, embora o horário tenha mudado, os leitores não se queixaram. No verão de 2003 chegaram 120 visitantes por dia, quase o dobro do que antes.",
    )
    prose = []
    for s in sentences:
        prose += ["\n\n".join(f"{s} {s}" for _ in range(4)), f"{s} {s} {s}".lower(), re.sub(r"(.{50,66}) ", r"\1\n", " ".join([s] * 6)), re.sub(r"(.{30,44}) ", r"\1\n", " ".join([s] * 6))]
        prose += ["# " + noun[0] + "\n\n" + " ".join([s] * 3) + "\n\n" + "\n".join(f"- {x}" for x in noun[:5]) + "\n\n" + " ".join([s] * 3), s + "\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\n" + s]
    lists = [
        [f"- {x}" for x in noun * 3], [f"{i}. {x}" for i, x in enumerate(noun * 3, 1)], [f"* {i * 25} g {x}" for i, x in enumerate(noun * 3, 1)], [f"• {x} {t}" for x, t in zip(noun * 3, place * 4)],
        [f"- [{x}](https://{t.lower()}.example/{i})" for i, (x, t) in enumerate(zip(noun * 3, place * 4))], people, [f"{x}, {y}" for x, y in zip(people, noun * 4)], noun * 3, [f"{x} ({1900 + i})" for i, x in enumerate(noun * 3)],
    ]
    cells = [(t, str(i * 613 + 48), f"{i * 2.9:.1f}", a) for i, (t, a) in enumerate(zip(place * 3, "north south east west".split() * 6), 1)]
    tables = ["\n".join(sep.join(c) for c in cells) for sep in (";", "\t", " | ", ",")]
    tables += [
        "| a | b | c | d |\n|---|---|---|---|\n" + "\n".join("| " + " | ".join(c) + " |" for c in cells),
        "\n".join(f"{c[0]:<18}{c[1]:>9}{c[2]:>9}    {c[3]}" for c in cells),
        "\n".join(f"{c[0]} {'.' * 22} {c[1]} ....... {c[2]}" for c in cells),
        "\n".join("  ".join(f"{i * j:>7}" for j in (3, 11, 47, 5, 97)) for i in range(1, 24)),
    ]
    rng = np.random.default_rng(5)

    def noise(alphabet: str, width: int) -> str:
        return "\n".join("".join(rng.choice(list(alphabet), width)) for _ in range(18))

    junk = [
        "\n".join(f"2024-03-{i % 28 + 1:02d}T{i % 24:02d}:{i * 7 % 60:02d}:{i * 13 % 60:02d}Z INFO http[{i * 37}] GET /a/{i * 7919:x} {200 + i % 4} {i * 3}ms" for i in range(1, 24)),
        "\n".join(f"Exception in thread {i}: at x.y.Z{i * 13:x}(Z.java:{i * 7}) [0x{i * 104729:08x}]" for i in range(1, 24)),
        "\n".join(f"{i * 16:08x}  " + " ".join(f"{x:02x}" for x in rng.integers(0, 256, 16)) for i in range(1, 24)),
        noise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64), noise("!#$%&*+-./:;<=>?@[]^_{|}~\\", 60), noise("lI1|it.,'`~^·¬rnm    ", 66), noise("asdfghjklqwertyuiop   ", 70), noise("bcdfghjklmnpqrstvwxz   ", 60),
        *("\n".join(" ".join([w] * k) for k in (8, 12, 9, 11, 10, 12, 8, 9)) for w in ("spam", "Inicio")), "\n".join("\\x" + " \\x".join(f"{x:02x}" for x in rng.integers(0, 256, 20)) for _ in range(20)),
    ]
    return [("prose", x) for x in prose] + [("list", "\n".join(x)) for x in lists] + [("table", x) for x in tables] + [("junk", x) for x in junk]


class Mixture:
    """Gaussian mixture with full covariances over standardized statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, centres: np.ndarray, covariances: np.ndarray, kinds: list[str] | None = None):
        self.mean, self.scale, self.weights, self.centres, self.covariances, self.kinds = mean, scale, weights, centres, covariances, kinds or []

    def standard(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.scale

    def log_joint(self, z: np.ndarray) -> np.ndarray:
        out = np.empty((len(z), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.centres, self.covariances)):
            low = np.linalg.cholesky(c)
            d = np.linalg.solve(low, (z - m).T)
            out[:, k] = np.log(w) - (d * d).sum(0) / 2 - np.log(np.diag(low)).sum()
        return out

    def responsibilities(self, z: np.ndarray) -> np.ndarray:
        j = self.log_joint(z)
        j -= j.max(1, keepdims=True)
        e = np.exp(j)
        return e / e.sum(1, keepdims=True)


#: Partitions above which the partial sums are added up in tasks before they go to the driver, and into how many.
MANY_PARTITIONS, SUM_TASKS = 256, 32


def _summed(parts: DataFrame) -> dict[str, np.ndarray | float]:
    """Sums of the columns (numbers or arrays) of partial rows, of which every partition of the input gave one."""
    schema = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    names = [n for n, _ in parts.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b.to_pylist() for b in batches]
        total = _added([r for part in rows for r in part], names)
        if total:
            yield pa.RecordBatch.from_pylist([{n: v.tolist() if isinstance(v, np.ndarray) else v for n, v in total.items()}], schema=arrow)

    arrow = pa.schema([(n, pa.float64() if t == "double" else pa.list_(pa.float64())) for n, t in parts.dtypes])
    if len(parts.inputFiles()) > MANY_PARTITIONS:
        parts = parts.repartition(SUM_TASKS).mapInArrow(run, schema)
    return _added([r.asDict() for r in parts.collect()], names)


def _added(rows: list[dict], names: list[str]) -> dict[str, np.ndarray | float]:
    return {n: sum(np.asarray(r[n], float) if isinstance(r[n], list) else r[n] for r in rows) for n in names} if rows else {}


def _moments(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
        for b in batches:
            x = _features({k: b.column(k).to_numpy(zero_copy_only=False) for k in FEATURES})
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([q.tolist()], pa.list_(pa.float64()))], names=["n", "s", "q"])

    parts = stats.select(*FEATURES).mapInArrow(run, "n double, s array<double>, q array<double>")
    total = _summed(parts)
    if not total:
        return np.zeros(len(FEATURES)), np.ones(len(FEATURES))
    n = max(1.0, total["n"])
    mean = total["s"] / n
    var = total["q"] / n - mean**2
    return mean, np.sqrt(np.maximum(var, 1e-4))


def first_centres(z: np.ndarray, k: int = COMPONENTS) -> np.ndarray:
    """Up to ``k`` of the rows ``z``: the one next to the middle, then each by chance in proportion to its squared distance
    from those taken, so that rare kinds of rows have centres too."""
    rng = np.random.default_rng(1)
    taken = [int(((z - z.mean(0)) ** 2).sum(1).argmin())]
    d = ((z - z[taken[0]]) ** 2).sum(1)
    while len(taken) < k and d.sum() > 1e-9:
        taken.append(int(rng.choice(len(z), p=d / d.sum())))
        d = np.minimum(d, ((z - z[taken[-1]]) ** 2).sum(1))
    return z[taken]


def fit(stats: DataFrame, common: Iterable[str], rounds: int = ROUNDS) -> Mixture:
    """Expectation-maximization over all rows of ``stats``; only sums per component and partition reach the driver.

    The first centres are rows chosen from SEED_ROWS of them; then all rows take part. What the components are is named
    afterwards: each takes the kind of the examples it is most responsible for, one that holds none of them the kind of
    the example next to its centre by its own covariance."""
    mean, scale = _moments(stats)
    d = len(FEATURES)
    rows = stats.select("doc_id", *FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SEED_ROWS).select(*FEATURES).collect()
    if not rows:
        return Mixture(mean, scale, np.ones(1), np.zeros((1, d)), np.eye(d)[None], ["prose"])
    centres = first_centres((_features({f: np.array([r[f] for r in rows]) for f in FEATURES}) - mean) / scale)
    k = len(centres)
    m = Mixture(mean, scale, np.full(k, 1 / k), centres, np.repeat(np.eye(d)[None] * FIRST, k, 0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
        for b in batches:
            z = m.standard(_features({f: b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES}))
            if len(z):
                r = m.responsibilities(z)
                n, s = n + r.sum(0), s + r.T @ z
                for j in range(k):
                    q[j] += (z * r[:, j, None]).T @ z
        yield pa.RecordBatch.from_arrays([pa.array([n.tolist()], pa.list_(pa.float64())), pa.array([s.ravel().tolist()], pa.list_(pa.float64())), pa.array([q.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "s", "q"])

    for _ in range(rounds):
        total = _summed(stats.select(*FEATURES).mapInArrow(sums, "n array<double>, s array<double>, q array<double>"))
        n, s, q = total["n"], total["s"].reshape(k, d), total["q"].reshape(k, d, d)
        c = np.where(n[:, None] > 1, s / np.maximum(n, 1e-9)[:, None], m.centres)
        cross = s[:, :, None] * c[:, None, :]
        about = q - cross - cross.transpose(0, 2, 1) + n[:, None, None] * c[:, :, None] * c[:, None, :]
        cov = (about + PRIOR * FIRST * np.eye(d)) / (n + PRIOR)[:, None, None] + RIDGE * np.eye(d)
        m = Mixture(mean, scale, (n + 0.5) / (n + 0.5).sum(), c, cov)
    shown = examples()
    known = frozenset(common)
    seen = [dict(zip(STATISTICS, statistics(t, known))) for _, t in shown]
    z0 = m.standard(_features({f: np.array([r[f] for r in seen]) for f in FEATURES}))
    m.kinds = _named(m, z0, [kind for kind, _ in shown])
    return m


def _named(m: Mixture, z: np.ndarray, kinds: list[str]) -> list[str]:
    r = m.responsibilities(z)
    out = []
    for j in range(len(m.weights)):
        votes = {kind: sum(x for x, y in zip(r[:, j], kinds) if y == kind) for kind in dict.fromkeys(kinds)}
        best = max(votes, key=votes.__getitem__)
        if votes[best] < 0.5:
            low = np.linalg.cholesky(m.covariances[j] + FIRST * np.eye(z.shape[1]))
            best = kinds[int((np.linalg.solve(low, (z - m.centres[j]).T) ** 2).sum(0).argmin())]
        out.append(best)
    return out


def classified(stats: DataFrame, model: Mixture) -> DataFrame:
    """stats with ``kind`` (prose, list, table, junk) and ``confidence``, the posterior of that kind."""
    order = sorted(set(model.kinds))
    member = np.array([[float(k == o) for o in order] for k in model.kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = model.standard(_features({f: b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES}))
            p = model.responsibilities(z) @ member if len(z) else np.zeros((0, len(order)))
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([order[i] for i in best], pa.string()), pa.array(p.max(1) if len(p) else [], pa.float64())], names=[*b.schema.names, "kind", "confidence"])

    return stats.mapInArrow(run, SCHEMA + ", kind string, confidence double")


def document_kinds(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Statistics, kind and confidence of every document. Blank texts have zero statistics; repeated rows stay."""
    stats = stored(document_statistics(documents, common_words), "statistics")
    common = [r.word.lower() for r in common_words.select("word").collect() if r.word]
    return classified(stats, fit(stats, common))


