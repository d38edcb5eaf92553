"""Personal data: fixed patterns, and a conditional random field for what they miss.

Patterns give the base spans. A linear-chain conditional random field over the shapes of words is
trained on a small table of marked word runs taken from the documents themselves: what the patterns
find is marked, everything else is not, and copies with a dropped country code or other separators
teach forms that the patterns do not know. It is decoded by Viterbi over batches of runs, and its
spans are added where no base span lies.

A run is a maximal sequence of neighbouring words with a digit or an at sign, with the word before
and the word after it. All other words are outside by definition, so they need no decoding.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),  # a part never begins inside digits
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LABELS = ("O", *(f"{side}-{kind}" for kind in KINDS for side in "BI"))
LABELLED_RUNS = 2000  # rows of the labelled table
RUN_WORDS = 32  # words of a run that are trained on
EPOCHS = 40
RATE = 0.5
RIDGE = 1e-3

MARKED_WORD = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
DECODED_WORDS = 1 << 18  # words decoded side by side
NEAR = 48  # characters looked at for the word beside a run
EDGE = " \t\n.,;:!?\"'[]{}<>|*#%&$"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def holds(kind: str, found: str) -> bool:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        parts = [p.lstrip("0") for p in found.split(".")]  # a part may have any number of zeros
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    if kind == "card":
        digits = digits_of(found)
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits_of(found)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans by kind and start, in code points; matches that fail are dropped."""
    spans = []
    for kind in KINDS:
        if kind == "email" and "@" not in text:
            continue
        if kind == "phone" and "+" not in text:
            continue
        matches = _emails(text) if kind == "email" else PATTERNS[kind].finditer(text)
        spans += [(kind, m.start(), m.end()) for m in matches if holds(kind, m[0])]
    return spans


def _emails(text: str):
    """Leftmost matches of the email pattern, tried only where an at sign can be reached.

    The characters before an at sign are found backwards, so a long word without one costs no more
    than its length.
    """
    local, at, floor = PATTERNS["email"], text.find("@"), 0
    allowed = re.compile(r"[A-Za-z0-9._%+-]*")
    while at >= 0:
        reach = allowed.match(text[floor:at][::-1]).end() if at - floor < 4096 else _reach(text, floor, at)
        found = local.match(text, at - reach) if reach else None
        if found:
            yield found
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def _reach(text: str, floor: int, at: int) -> int:
    low, step = at, 4096
    while low > floor:
        part = text[max(floor, low - step): low]
        kept = re.match(r"[A-Za-z0-9._%+-]*", part[::-1]).end()
        low -= kept
        if kept < len(part):
            break
    return at - low


# --- runs and their features -----------------------------------------------------------


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Words (start, end) of each run, without the words beside it."""
    out: list[list[tuple[int, int]]] = []
    for found in MARKED_WORD.finditer(text):
        if out and not text[out[-1][-1][1]: found.start()].strip():
            out[-1].append(found.span())
        else:
            out.append([found.span()])
    return out


def beside(text: str, run: list[tuple[int, int]]) -> tuple[str, str]:
    before = text[max(0, run[0][0] - NEAR): run[0][0]].split()
    after = text[run[-1][1]: run[-1][1] + NEAR].split()
    return (before[-1] if before else ""), (after[0] if after else "")


def shape(word: str) -> str:
    return re.sub(r"[^\W\d_]", "x", re.sub("[0-9]", "d", word[:64]))


def short_shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", shape(word))


def word_features(words: list[str], at: int) -> list[str]:
    word = words[at][:256]
    word = word.strip(EDGE) or word
    full, count = shape(word), sum(c in "0123456789" for c in word)
    before = short_shape(words[at - 1].strip(EDGE)) if at else "^"
    after = short_shape(words[at + 1].strip(EDGE)) if at + 1 < len(words) else "$"
    return [
        "bias", f"full={full[:32]}", f"short={short_shape(word)}", f"digits={min(count, 20)}",
        f"head={full[:3]}", f"tail={full[-3:]}", f"at={word.count('@')}", f"dots={min(word.count('.'), 5)}",
        f"plus={word[:1] == '+'}", f"before={before}", f"after={after}", f"pair={before}|{short_shape(word)}",
    ]


# --- labelled table ---------------------------------------------------------------------


def labels_of(run: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """Label of each word: the base span that it overlaps, the longest one first."""
    marks = [0] * len(run)
    for kind, start, end in sorted(spans, key=lambda s: s[1] - s[2]):
        inside = [i for i, (a, b) in enumerate(run) if a < end and start < b]
        if inside and not any(marks[i] for i in inside):
            for i in inside:
                marks[i] = LABELS.index(f"{'B' if i == inside[0] else 'I'}-{kind}")
    return marks


def variants(words: list[str], marks: list[int]) -> list[tuple[list[str], list[int]]]:
    """The run, and copies in other forms: a phone without country code, a card with dots."""
    out = [(words, marks)]
    phone, card = LABELS.index("B-phone"), LABELS.index("B-card")
    for i, word in enumerate(words):
        if marks[i] == phone and re.fullmatch(r"\+[0-9]{1,3}", word) and i + 1 < len(words) \
                and marks[i + 1] == phone + 1:
            rest = [phone if k == i + 1 else m for k, m in enumerate(marks)]
            out.append((words[:i] + words[i + 1:], rest[:i] + rest[i + 1:]))
        if marks[i] == card and re.fullmatch("[0-9]{16}", word):
            dotted = ".".join(word[k: k + 4] for k in range(0, 16, 4))
            out.append((words[:i] + [dotted] + words[i + 1:], marks))
    return out


def _labelled(batches):
    for batch in batches:
        words, marks = [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text) if text else []
            for run in runs(text or ""):
                before, after = beside(text, run)
                words.append([before, *[text[a:b][:256] for a, b in run[:RUN_WORDS]], after])
                marks.append([0, *labels_of(run, spans)[:RUN_WORDS], 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int32()))], ["words", "marks"]
        )


def labelled_runs(documents: DataFrame, rows: int = LABELLED_RUNS) -> list[tuple[list[str], list[int]]]:
    """The labelled table: distinct runs, half of them with a base span, first in hash order."""
    table = documents.where(F.rlike("text", F.lit("[0-9@]"))).select("text").mapInArrow(
        _labelled, "words array<string>, marks array<int>"
    ).distinct().withColumn("marked", F.array_max("marks") > 0)
    out = []
    for marked in (True, False):
        part = (
            table.where(F.col("marked") == marked).select("words", "marks", F.xxhash64("words").alias("h"))
            .orderBy("h", F.col("words").cast("string")).limit(rows // 2)
        )
        out += [(list(r["words"]), list(r["marks"])) for r in part.collect()]
    return out


# --- the field ---------------------------------------------------------------------------


@dataclass
class Field:
    index: dict[str, int]  # feature to row; row 0 is no feature
    weights: np.ndarray
    steps: np.ndarray  # from label to label
    first: np.ndarray

    def emissions(self, run: list[str], known: dict[tuple, np.ndarray]) -> np.ndarray:
        out = []
        for at in range(len(run)):
            names = tuple(word_features(run, at))
            if names not in known:
                rows = [self.index[n] for n in names if n in self.index]
                known[names] = self.weights[rows].sum(axis=0)
            out.append(known[names])
        return np.array(out)


def padded(sequences: list[np.ndarray], width: int, fill: float = 0.0) -> np.ndarray:
    out = np.full((len(sequences), max(map(len, sequences)), width), fill)
    for i, s in enumerate(sequences):
        out[i, : len(s)] = s
    return out


def viterbi(emissions: list[np.ndarray], steps: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Best labels of each sequence; sequences of a batch advance together, those that end stop.

    A batch, filled up to its longest sequence, has at most DECODED_WORDS words, or one sequence.
    """
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    out: list[np.ndarray] = [np.empty(0, int)] * len(emissions)
    low = 0
    while low < len(order):
        part = order[low: low + max(1, min(512, DECODED_WORDS // max(1, len(emissions[order[low]]))))]
        low += len(part)
        lengths = np.array([len(emissions[i]) for i in part])
        scores = padded([emissions[i] for i in part], len(first))
        best = first + scores[:, 0]
        back = np.zeros(scores.shape, np.int8)
        for t in range(1, scores.shape[1]):
            live = int(np.searchsorted(-lengths, -t))  # sequences longer than t come first
            through = best[:live, :, None] + steps
            back[:live, t] = through.argmax(axis=1)
            best[:live] = through.max(axis=1) + scores[:live, t]
        for row, i in enumerate(part):
            path = np.empty(lengths[row], int)
            path[-1] = best[row].argmax()
            for t in range(lengths[row] - 1, 0, -1):
                path[t - 1] = back[row, t, path[t]]
            out[i] = path
    return out


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[int]]]) -> Field | None:
    """Fit by full-batch adaptive gradient steps on the penalised likelihood; None without a mark."""
    if not any(any(marks) for _, marks in table):
        return None
    table = [v for words, marks in table for v in variants(words, marks)]
    names = [[word_features(words, t) for t in range(len(words))] for words, _ in table]
    index = {n: i + 1 for i, n in enumerate(sorted({n for run in names for word in run for n in word}))}
    size, longest, kinds = len(table), max(len(m) for _, m in table), len(LABELS)
    width = len(names[0][0])
    rows = np.zeros((size, longest, width), int)
    gold = np.zeros((size, longest), int)
    live = np.zeros((size, longest), bool)
    for i, (run, (_, marks)) in enumerate(zip(names, table, strict=True)):
        rows[i, : len(run)] = [[index[n] for n in word] for word in run]
        gold[i, : len(marks)] = marks
        live[i, : len(marks)] = True
    params = {
        "weights": np.zeros((len(index) + 1, kinds)), "steps": np.zeros((kinds, kinds)),
        "first": np.zeros(kinds),
    }
    seen = {k: np.full_like(v, 1e-8) for k, v in params.items()}
    both = live[:, 1:]
    truth = np.eye(kinds)[gold] * live[:, :, None]
    pairs = np.einsum("ntk,ntl->kl", truth[:, :-1], truth[:, 1:] * both[:, :, None])
    for _ in range(EPOCHS):
        emit = params["weights"][rows].sum(axis=2)
        ahead = np.zeros((size, longest, kinds))
        behind = np.zeros((size, longest, kinds))
        ahead[:, 0] = params["first"] + emit[:, 0]
        for t in range(1, longest):
            new = _log_sum(ahead[:, t - 1, :, None] + params["steps"], 1) + emit[:, t]
            ahead[:, t] = np.where(live[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _log_sum(params["steps"] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(live[:, t + 1, None], new, 0.0)
        total = _log_sum(ahead[:, -1], 1)
        belief = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
        through = np.zeros((kinds, kinds))
        for t in range(longest - 1):
            joint = ahead[:, t, :, None] + params["steps"] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :]
            through += (np.exp(joint - total[:, None, None]) * both[:, t, None, None]).sum(axis=0)
        slack = belief - truth
        gradient = {"weights": np.zeros_like(params["weights"])}
        np.add.at(gradient["weights"], rows, slack[:, :, None, :])
        gradient["weights"][0] = 0
        gradient["steps"] = through - pairs
        gradient["first"] = slack[:, 0].sum(axis=0)
        for k, g in gradient.items():
            g = g / size + RIDGE * params[k]
            seen[k] += g * g
            params[k] -= RATE * g / np.sqrt(seen[k])
    return Field(index, params["weights"], params["steps"], params["first"])


# --- spans ---------------------------------------------------------------------------------


def plausible(kind: str, found: str) -> bool:
    """Whether a decoded span can be what its label says."""
    digits = digits_of(found)
    if kind == "email":
        return re.search(r"\w@\w", found) is not None
    if kind == "ip":
        return re.fullmatch(r"\d+(\.\d+){3}", found) is not None and holds("ip", found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", found)
    return 8 <= len(digits) <= 15 and not re.search("[A-Za-z@]", found)


def decoded_spans(text: str, run: list[tuple[int, int]], path: np.ndarray) -> list[tuple[str, int, int]]:
    spans, at = [], 0
    while at < len(run):
        label = LABELS[path[at]]
        end = at + 1
        if label != "O":
            while end < len(run) and LABELS[path[end]] == f"I-{label[2:]}":
                end += 1
            start, stop = run[at][0], run[end - 1][1]
            while start < stop and text[start] in EDGE:
                start += 1
            while start < stop and text[stop - 1] in EDGE + "(":
                stop -= 1
            if plausible(label[2:], text[start:stop]):
                spans.append((label[2:], start, stop))
        at = end
    return spans


def find_spans(texts: list[str | None], field: Field | None):
    """(base spans, all spans) of each text; spans of the field never overlap a base span."""
    base = [base_spans(t) if t else [] for t in texts]
    found = [list(b) for b in base]
    if field is not None:
        known: dict[tuple, np.ndarray] = {}
        places, emissions = [], []
        for owner, text in enumerate(texts):
            for run in runs(text or ""):
                before, after = beside(text, run)
                places.append((owner, run))
                emissions.append(field.emissions([before, *[text[a:b] for a, b in run], after], known))
        for (owner, run), path in zip(places, viterbi(emissions, field.steps, field.first), strict=True):
            for span in decoded_spans(texts[owner], run, path[1:-1]):
                if all(span[2] <= a or b <= span[1] for _, a, b in found[owner]):
                    found[owner].append(span)
    order = {kind: i for i, kind in enumerate(KINDS)}
    return base, [sorted(f, key=lambda s: (order[s[0]], s[1])) for f in found]


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_personal_data(documents: DataFrame, labelled_rows: int = LABELLED_RUNS) -> DataFrame:
    """(doc_id, spans) of each document; spans have kind, start, end (code points) and base.

    A null text counts as empty and has no spans. Without a single base span in the documents there
    is nothing to learn from, and only base spans, that is none, are given. Repeated rows are rows
    of their own; an empty table gives no rows; other columns are not read. The labelled table is
    bounded by ``labelled_rows``; finding covers whole texts.
    """
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    shared = rows.sparkSession.sparkContext.broadcast(train(labelled_runs(rows, labelled_rows)))

    def run(batches):
        for batch in batches:
            base, spans = find_spans(batch.column(1).to_pylist(), shared.value)
            out = [
                [{"kind": k, "start": a, "end": b, "base": (k, a, b) in set(own)} for k, a, b in all_]
                for own, all_ in zip(base, spans, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPAN_TYPE)], ["doc_id", "spans"])

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
