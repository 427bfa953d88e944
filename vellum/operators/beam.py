"""Beam search and CTC forward scores: iterative, so numpy per image in Arrow batches, over a pluggable step function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import BOS, EOS

Step = Callable[[np.ndarray, list[int]], np.ndarray]


def log_softmax(x: np.ndarray) -> np.ndarray:
    z = x - x.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def ctc_forward(log_p: np.ndarray, labels: list[int], blank: int = 0) -> float:
    """Log-probability of the labels over all alignments, by label; without labels the mean log-probability of blanks."""
    if not labels:
        return float(log_p[:, blank].mean())
    ext = np.full(2 * len(labels) + 1, blank)
    ext[1::2] = labels
    jump = np.zeros(len(ext), bool)
    jump[2:] = (ext[2:] != blank) & (ext[2:] != ext[:-2])
    alpha = np.full(len(ext), -np.inf)
    alpha[:2] = log_p[0, ext[:2]]
    for row in log_p[1:]:
        one = np.concatenate([[-np.inf], alpha[:-1]])
        two = np.where(jump, np.concatenate([[-np.inf, -np.inf], alpha[:-2]]), -np.inf)
        alpha = np.logaddexp(np.logaddexp(alpha, one), two) + row[ext]
    return float(np.logaddexp(alpha[-1], alpha[-2]) / len(labels))


def penalise(log_p: np.ndarray, seq: list[int], unk: int | None = None) -> np.ndarray:
    """Lower scores of tokens that would go on with a repetition."""
    out, n = log_p.copy(), len(seq)
    if n >= 4:
        if seq[-1] == seq[-2] == seq[-3]:
            out[seq[-1]] -= 3.0
        if seq[-2:] == seq[-4:-2]:
            out[seq[-1]] -= 2.5
            out[seq[-2]] -= 2.5
        if seq[-1] == seq[-3] and seq[-2] == seq[-4]:
            out[seq[-1]] -= 2.5
    if n >= 6 and seq[-3:] == seq[-6:-3]:
        for t in seq[-3:]:
            out[t] -= 2.0
    if unk is not None:
        out[unk] -= 10.0
    return out


@dataclass(frozen=True)
class Search:
    """Fixed values of a search: widths, weights and penalties."""

    beam: int = 3
    power: float = 0.8
    language: float = 0.35
    alignment: float = 0.5
    end_bias: float = 0.0
    end_boost: float = 0.0
    end_until: int = 2
    unknown: int | None = None
    most: int = 512
    ratio: float = 1.3
    extra: int = 10

    def steps(self, memory: int, target: int | None) -> int:
        """Rounds at most: by the CTC text's length where that is known, else by the memory's."""
        return min(self.most, (int(target * self.ratio) if target else memory) + self.extra)


def end_bonus(length: int, target: int | None, how: Search) -> float:
    least = min(how.end_until, max(1, int(target * 0.5))) if target else how.end_until
    if length < least:
        return -how.end_bias
    return how.end_boost if target and length >= target else 0.0


def next_scores(memory: np.ndarray, seq: list[int], step: Step, language: Step | None, target: int | None, how: Search) -> np.ndarray:
    """Log-probabilities of what follows: the decoder's, the language model's added, ends and repetitions weighed."""
    lp = step(memory, seq)
    if language is not None:
        lp = lp + how.language * language(memory, seq)
    lp = penalise(lp, seq, how.unknown)
    lp[EOS] += end_bonus(len(seq) - 1, target, how)
    return lp


@dataclass
class Hypothesis:
    score: float
    seq: list[int]
    steps: list[float]
    done: bool

    def length(self) -> int:
        return max(1, len(self.seq) - 1)

    def body(self) -> list[int]:
        ids = self.seq[1:]
        return ids[: ids.index(EOS)] if EOS in ids else ids

    def confidence(self) -> float:
        return min(1.0, float(np.exp(np.mean(self.steps)))) if self.steps else 0.0


def rounds(memory: np.ndarray, step: Step, how: Search, steps: int, language: Step | None = None, target: int | None = None, streaming: bool = False) -> Iterator[list[Hypothesis]]:
    """The best hypotheses after each round, best first. Finished ones compete on; scores are divided by a length penalty,
    ((5 + n) / 6) ** power or, streaming, n ** power."""
    normed = (lambda h: h.score / h.length() ** how.power) if streaming else (lambda h: h.score / ((5 + h.length()) / 6) ** how.power)
    state = [Hypothesis(0.0, [BOS], [], False)]
    for _ in range(steps):
        if all(h.done for h in state):
            return
        grown = [h for h in state if h.done]
        for h in state:
            if not h.done:
                lp = next_scores(memory, h.seq, step, language, target, how)
                for t in np.argsort(-lp, kind="stable")[: how.beam]:
                    grown.append(Hypothesis(h.score + float(lp[t]), [*h.seq, int(t)], [*h.steps, float(lp[t])], int(t) == EOS))
        state = sorted(grown, key=normed, reverse=True)[: how.beam]
        yield state


def greedy_length(log_p: np.ndarray) -> tuple[int, float]:
    """Number of tokens of the greedy CTC reading, and the mean of the frames' best probabilities."""
    best = log_p.argmax(axis=1)
    fresh = np.concatenate([[True], best[1:] != best[:-1]])
    return int(((best >= 2) & fresh).sum()), float(np.exp(log_p.max(axis=1)).mean())


def beam_search(memory: np.ndarray, step: Step, how: Search, ctc: np.ndarray | None = None, language: Step | None = None, steps: int | None = None) -> tuple[list[int], float, float]:
    """(ids without BOS and EOS, final score, confidence). The final score adds the CTC alignment's; the confidence is the
    decoder's, mixed 6 to 4 with the CTC reading's where there is one."""
    target, ctc_confidence = greedy_length(ctc) if ctc is not None else (None, None)
    state = [Hypothesis(0.0, [BOS], [], False)]
    for state in rounds(memory, step, how, steps or how.steps(len(memory), target), language, target):  # noqa: B007
        pass

    def final(h: Hypothesis) -> float:
        score = h.score / h.length() ** how.power
        if ctc is not None and how.alignment > 0:
            score += how.alignment * ctc_forward(ctc, [t - 1 for t in h.body() if t > EOS])
        return score

    best = max(state, key=final)
    confidence = best.confidence() if ctc_confidence is None else 0.6 * best.confidence() + 0.4 * ctc_confidence
    return best.body(), final(best), confidence


def stream(memory: np.ndarray, step: Step, how: Search, language: Step | None = None, greedy: bool = False, steps: int | None = None) -> Iterator[tuple[int, list[int], list[int], float, bool]]:
    """(step, new ids, ids so far, confidence, finished) of each round. greedy: the decoder's likeliest token, which penalties
    don't change, with its probability; else the best hypothesis of a beam, whose new ids may be none."""
    most = steps or how.steps(len(memory), None)
    if greedy:
        seq = [BOS]
        for n in range(1, most + 1):
            lp = step(memory, seq)
            token = int(lp.argmax())
            seq.append(token)
            shown = [t for t in seq if t > EOS and t != how.unknown]
            yield n, [token] if token > EOS and token != how.unknown else [], shown, float(np.exp(lp[token])), token == EOS
            if token == EOS:
                return
        return
    before = 0
    for n, state in enumerate(rounds(memory, step, how, most, language, None, True), 1):
        ids = [t for t in state[0].body() if t > EOS and t != how.unknown]
        yield n, ids[before:], ids, state[0].confidence(), state[0].done
        before = len(ids)
        if state[0].done:
            return


def table_step(memory: np.ndarray, seq: list[int]) -> np.ndarray:
    """A stand-in for a network: the frame at the sequence's length is the next token's distribution."""
    row = log_softmax(memory[min(len(seq) - 1, len(memory) - 1)])
    if len(seq) > len(memory):
        row = row.copy()
        row[EOS] += 20.0
    return row


def packed(frames: DataFrame) -> DataFrame:
    return frames.groupBy("image_id").agg(F.collect_list(F.struct("t", "logits")).alias("frames"))


def memories(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for image, rows in zip(batch["image_id"], batch["frames"], strict=True):
        yield image, np.array([r["logits"] for r in sorted(rows, key=lambda r: r["t"])], float)


def decode(frames: DataFrame, beam: int = 3, step: Step = table_step, steps: int | None = None, language: Step | None = None, how: Search | None = None) -> DataFrame:
    """(image_id, ids, score, alignment, confidence) of each image's frames, which stand for its CTC reading as well; beam 1 is
    the search called accurate."""
    how = replace(how or Search(), beam=beam)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for image, memory in memories(b):
                lp = log_softmax(memory)
                ids, score, confidence = beam_search(memory, step, how, lp, language, steps)
                out.append((image, ids, score, ctc_forward(lp, [i - 1 for i in ids if i > EOS]), confidence))
            yield pd.DataFrame(out, columns=["image_id", "ids", "score", "alignment", "confidence"])

    return packed(frames).mapInPandas(run, "image_id int, ids array<int>, score double, alignment double, confidence double")


def decode_stream(frames: DataFrame, greedy: bool = True, step: Step = table_step, language: Step | None = None, how: Search | None = None) -> DataFrame:
    """(image_id, step, tokens, ids, confidence, finished): a row a round of each image's search (see stream)."""
    how = how or Search()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for image, memory in memories(b):
                got = [(image, *e) for e in stream(memory, step, how, language, greedy)]
                yield pd.DataFrame(got, columns=["image_id", "step", "tokens", "ids", "confidence", "finished"])

    return packed(frames).mapInPandas(run, "image_id int, step int, tokens array<int>, ids array<int>, confidence double, finished boolean")
