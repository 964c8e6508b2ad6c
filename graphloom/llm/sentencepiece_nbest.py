"""SentencePiece encoding and decoding by N-best segmentation over the piece lattice.

The vocabulary and scores come from a SentencePiece model file; nothing is trained. A text is normalised as that model does
(a space put before it, spaces written as U+2581). The lattice has an edge for each piece of the vocabulary; a character that is no piece
by itself has one edge of its UTF-8 bytes' pieces. A forward Viterbi pass gives the best score of every prefix, which is the exact
heuristic of a backward A* search: it takes partial paths from the end in order of their exact
best totals, so the first N paths that reach the start are the N best. The best path and the loss of the second best follow from the forward scores and
one look back over the edges, so the search runs only for those parts of a text whose later paths can be among its N best.

Where no piece of the vocabulary holds two neighbouring characters, every path has a node between them. Texts are cut there (before
each U+2581 that does not follow another one first, so a run of spaces stays with its word, and around line breaks), each part is searched once and kept, and a text's N best paths are merged from the few parts with the smallest
loss: at most N - 1 of them can differ from their own best in the N best.

Scores are the model's, as integers (a BPE model's are the negative ranks of its merges), so sums are exact; a byte piece costs
``BYTE_SCORE``. Paths with equal totals stand in the order in which the search meets them.

Nulls and odd rows: a null text counts as empty and has no pieces; its N best are one empty path. Repeated rows are each encoded. Empty
tables give no rows. Columns other than those asked for are passed on or ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.chars import groups
from graphloom.llm.shared import table

NBEST = 3
SPACE = "▁"
BYTE_SCORE = -40_000
#: Parts, and their characters in all, that a worker keeps between groups of texts; beyond that only parts met again stay.
CACHE, CACHE_CHARS = 300_000, 5_000_000
#: Characters of texts that are encoded at once, about.
GROUP_CHARS = 250_000
#: First loss of a part that has one path only.
NEVER = 1 << 62
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Closing signs: texts are cut between a letter and those of them that no piece holds after a letter.
SIGNS = ".,;:!?*#$%&|"


class Known(dict):
    """Places of parts; those that are missing are added."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, part: str) -> int:
        self[part] = at = self.add(part)
        return at


class Lattice:
    """The pieces of a model, and the N best paths of texts."""

    def __init__(self, path: str, n: int = NBEST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n
        self.pieces: dict[str, tuple[int, int]] = {}
        self.byte_id: dict[int, int] = {}
        self.text_of: list[bytes] = []
        joined: set[str] = set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.text_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text_of.append(b"" if model.is_control(i) else piece.replace(SPACE, " ").encode())
            else:
                self.pieces[piece] = (max(round(model.get_score(i)), -model.get_piece_size()), i)  # the bound: user-defined pieces have no rank
                self.text_of.append(piece.replace(SPACE, " ").encode())
                joined.update(map("".join, zip(piece, piece[1:])))
        #: Pieces by character: for each character the tree below it, and the score and ids of the piece that ends there, if any.
        self.tree: dict[str, list] = {}
        for piece, (score, i) in self.pieces.items():
            below = self.tree
            for c in piece:
                node = below.setdefault(c, [{}, 0, None])
                below = node[0]
            node[1:] = score, (i,)
        self.joined = joined
        after_letter = {x[1] for x in joined if x[0].isalpha() and x[0] != SPACE}
        signs = re.escape("".join(x for x in SIGNS if x not in after_letter))
        runs = rf"{SPACE}?[{LETTERS}]+(?=[{signs}{SPACE}]|\Z)|{SPACE}?[{signs}]+(?={SPACE}|\Z)|" if signs else ""
        # Texts are also cut around line breaks, if no piece holds one together with another character.
        lines = r"\n" if not any("\n" in x for x in joined) else ""
        self.parts = re.compile(rf"{runs}{SPACE}+[^{SPACE}{lines}]*|" + f"{lines}|" * bool(lines) + rf"[^{SPACE}{lines}]+")
        self.decoder = np.asarray(self.text_of, object)
        self._clear()

    def forward(self, part: str) -> tuple[list[int], list[list[tuple]]]:
        """Best score of every prefix, and at every place the edges that end there: (best score through the edge, start, ids)."""
        size, tree, chars = len(part), self.tree, list(part)
        best, into = [NEVER * -1] * (size + 1), [[] for _ in range(size + 1)]
        best[0] = 0
        for start in range(size):
            here, end, node = best[start], start + 1, tree.get(chars[start])
            if node is None or node[2] is None:
                ids = tuple(self.byte_id[b] for b in part[start].encode())
                total = here + BYTE_SCORE * len(ids)
                into[end].append((total, start, ids))
                if total > best[end]:
                    best[end] = total
            while node is not None:
                below, score, ids = node
                if ids is not None:
                    total = here + score
                    into[end].append((total, start, ids))
                    if total > best[end]:
                        best[end] = total
                if end == size:
                    break
                node = below.get(chars[end])
                end += 1
        return best, into

    def best_path(self, part: str) -> tuple[int, int, tuple[int, ...]]:
        """Best score, loss of the second best path (NEVER: there is none) and ids of the best.

        The second best path has an edge off the best one, so its loss is the least of any such edge's, from both sides' best scores.
        """
        best, into = self.forward(part)
        size = len(part)
        rest, top, least, even = [NEVER * -1] * size + [0], best[size], NEVER, 0
        for end in range(size, 0, -1):
            after = rest[end]
            for total, start, _ in into[end]:
                loss = top - total - after
                if not loss:
                    even += 1
                elif loss < least:
                    least = loss
                if total - best[start] + after > rest[start]:
                    rest[start] = total - best[start] + after
        ids, at, edges = [], size, 0
        while at:
            need = best[at]
            for total, start, own in into[at]:
                if total == need:
                    break
            ids.append(own)
            at, edges = start, edges + 1
        return top, 0 if even > edges else least, tuple(chain.from_iterable(reversed(ids)))

    def search(self, part: str) -> list[tuple[int, tuple[int, ...]]]:
        """(score, ids) of the N best paths of a text, best first: A* from its end, with the forward scores as heuristic."""
        size, n = len(part), self.n
        best, into = self.forward(part)
        # Each open path stands for a whole path of just its loss, so beyond the N smallest losses of open paths none is needed.
        out, heap, bound, order = [], [(0, 0, size, None)], [0], 0
        while heap and len(out) < n:
            loss, _, at, link = heapq.heappop(heap)
            if not at:
                ids = ()
                while link:
                    ids += link[0]
                    link = link[1]
                out.append((best[size] - loss, ids))
                continue
            here, kept = best[at], False
            for total, start, own in into[at]:
                more = loss + here - total
                if more > loss or kept:
                    if len(bound) == n:
                        if more >= bound[-1]:
                            continue
                        bound.pop()
                    insort(bound, more)
                else:
                    kept = True  # goes on in place of the path that was taken
                order += 1
                heapq.heappush(heap, (more, order, start, (own, link)))
        return out

    def _cuts(self, part: str) -> list[str]:
        """The parts of ``part`` between neighbours that no piece holds together."""
        joined = self.joined
        at = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in joined]
        return [part[a:b] for a, b in zip([0, *at], [*at, len(part)])] if at else [part]

    def _merged(self, alternatives: list[list[tuple[int, tuple]]]) -> list[tuple[int, tuple]]:
        """N best concatenations, one path from each list (each best first)."""
        now = [(0, ())]
        for paths in alternatives:
            now = heapq.nsmallest(self.n, ((a + s, ids + own) for a, ids in now for s, own in paths), key=lambda x: -x[0])
        return now

    def _clear(self) -> None:
        self.known = Known(self._add)
        self.chars = 0
        self.ids = array("I")  # of all parts' best paths, one after the other
        # of each part: best score, first loss (NEVER: no further path), first place and count of ids, whether they decode to it, how often it was met
        self.score, self.loss, self.first, self.count, self.whole, self.met = (array(t) for t in "qqqqbq")
        self.next: dict[int, tuple] = {}  # losses of the second to N-th path of those parts of which they were asked for

    def _add(self, part: str) -> int:
        """Place of a part that is not known yet."""
        paths = [self.best_path(c) for c in self._cuts(part)]
        at, before = len(self.score), len(self.ids)
        for x in paths:
            self.ids.extend(x[2])
        own = self.ids[before:]
        self.score.append(sum(x[0] for x in paths))
        self.loss.append(min(x[1] for x in paths))
        self.first.append(before)
        self.count.append(len(own))
        self.whole.append(b"".join(map(self.text_of.__getitem__, own)).decode("utf-8", "replace") == part.replace(SPACE, " "))
        self.met.append(0)
        self.chars += len(part)
        return at

    def _next(self, at: int, part: str) -> tuple:
        """Losses of a part's second to N-th best path."""
        if at not in self.next:
            paths = [self.search(c) for c in self._cuts(part)]
            self.next[at] = self._losses([[x[0][0] - s for s, _ in x[1:]] for x in paths])
        return self.next[at]

    def _shrink(self) -> None:
        """Forgets the parts that were met once, and long ones."""
        old, met = self.known, self.met
        keep = [(part, at) for part, at in old.items() if met[at] > 1 and len(part) <= 64]
        if len(keep) > CACHE // 2:
            keep = sorted(keep, key=lambda x: -met[x[1]])[: CACHE // 2]
        ids, score, loss, first, count, whole = self.ids, self.score, self.loss, self.first, self.count, self.whole
        self._clear()
        for part, at in keep:
            self.known[part] = len(self.score)
            self.score.append(score[at])
            self.loss.append(loss[at])
            self.first.append(len(self.ids))
            self.ids.extend(ids[first[at] : first[at] + count[at]])
            self.count.append(count[at])
            self.whole.append(whole[at])
            self.met.append(1)
            self.chars += len(part)

    def _losses(self, losses: list) -> tuple:
        """Losses of the 2nd to N-th best whole path: only the N - 1 parts with the smallest first loss can differ."""
        now = [0]
        for own in heapq.nsmallest(self.n - 1, (x for x in losses if x), key=lambda x: x[0]):
            now = heapq.nsmallest(self.n, (a + b for a in now for b in (0, *own)))
        return tuple(now[1:])

    def encode_arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[bool]]:
        """Ids of the best paths of all texts, the ends of each text's, its N best scores, and whether the ids decode to it."""
        if len(self.known) > CACHE or self.chars > CACHE_CHARS:
            self._shrink()
        # Texts are cut one by one: spaces at the end of one and the space before the next are no run.
        parts = [self.parts.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
        flat = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        met = np.frombuffer(self.met, np.int64)
        met += np.bincount(at, minlength=len(met))
        del met  # the array can't grow while numpy sees it
        ends = np.cumsum([len(x) for x in parts])
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        n = self.n - 1
        score = np.concatenate(([0], np.cumsum(np.frombuffer(self.score, np.int64)[at])))
        bad = np.concatenate(([0], np.cumsum(np.frombuffer(self.whole, np.int8)[at] == 0)))
        loss = np.frombuffer(self.loss, np.int64)[at]
        count = np.frombuffer(self.count, np.int64)[at]
        stop = np.concatenate(([0], np.cumsum(count)))
        ids = np.frombuffer(self.ids, np.uint32)[np.arange(stop[-1]) + np.repeat(np.frombuffer(self.first, np.int64)[at] - stop[:-1], count)]
        scores = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            # Only the N - 1 parts with the smallest first loss can differ from their best paths.
            best, own, few = int(score[b] - score[a]), loss[a:b], range(a, b)
            if b - a > n:
                few = (np.argpartition(own, n - 1)[:n] + a).tolist() if n else []
            scores.append([best, *(best - x for x in self._losses([self._next(int(at[i]), flat[i]) for i in few if loss[i] < NEVER]))])
        whole = (bad[ends] == bad[starts]).tolist()
        return ids, stop[ends], scores, [w and SPACE not in x for w, x in zip(whole, texts)]

    def encode_group(self, texts: list[str]) -> list[tuple[bytes, list[int]]]:
        """For each text: ids (little-endian, 32 bits) of the best path, and the N best scores."""
        ids, ends, scores, _ = self.encode_arrays(texts)
        return [(ids[a:b].astype("<u4").tobytes(), s) for a, b, s in zip([0, *ends[:-1].tolist()], ends.tolist(), scores)]

    def encode(self, text: str | None) -> tuple[bytes, list[int]]:
        return self.encode_group([text or ""])[0]

    def nbest(self, text: str | None) -> list[tuple[int, list[int]]]:
        """The N best (score, ids) of a whole text."""
        if not text:
            return [(0, [])]
        cuts = [c for p in self.parts.findall(SPACE + text.replace(" ", SPACE)) for c in self._cuts(p)]
        paths = [self.search(c) for c in cuts]
        return [(s, list(ids)) for s, ids in self._merged(paths)]

    def decode(self, ids: bytes) -> str:
        return b"".join(self.decoder[np.frombuffer(ids, "<u4")]).decode("utf-8", "replace")[1:]


_lattices: dict[tuple[str, int], Lattice] = {}


def lattice(path: str, n: int = NBEST) -> Lattice:
    """One lattice for each worker process, model and N."""
    if (path, n) not in _lattices:
        _lattices[path, n] = Lattice(path, n)
    return _lattices[path, n]


SCHEMA = "n_pieces long, pieces_crc32 long, best_score long, nbest_scores array<long>, round_trip boolean"


def _encode(path: str, n: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path, n)
        for batch in batches:
            row = 0
            for group in groups((x.as_py() for x in batch.column("text")), GROUP_CHARS):  # a batch's texts are never all strings at once
                ids, ends, scores, whole = own.encode_arrays(group)
                bounds = np.concatenate(([0], ends))
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [batch.column("doc_id").slice(row, len(group)), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64()), pa.array([x[0] for x in scores], pa.int64()), pa.array(scores, pa.list_(pa.int64())), pa.array(whole, pa.bool_())]
                names = ["doc_id", "n_pieces", "pieces_crc32", "best_score", "nbest_scores", "round_trip"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))))
                    names.append("pieces")
                yield pa.RecordBatch.from_arrays(columns, names)
                row += len(group)

    return run


def encoded(docs: DataFrame, path: str, *, n: int = NBEST, with_ids: bool = False) -> DataFrame:
    """doc_id, the counts and N best scores of every row, whether decoding gives the text again; ``with_ids``: also the ids of the best path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(path, n, with_ids), f"doc_id long, {SCHEMA}" + ", pieces array<int>" * with_ids)


def op5_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
