"""Best-fit packing into sequences of several permitted lengths.

Documents become pieces of at most the greatest length. Pieces are dealt by hash into groups of bounded size, which
pack on their own. In a group, pieces go longest first into the open bin that they leave the least room in. When none
fits, a bin is opened, of the length that costs least for a token if it is filled with what is still to come. That packing
competes with those that open one length throughout, and the bins with the most room of the cheapest are solved anew,
exactly, a few pieces at a time. At the end each bin shrinks to the least permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafquery.llm.common import materialize
from leafquery.ship import ship

#: Tokens meant for one group of pieces that pack together.
GROUP_TOKENS = 16 << 20
#: Pieces looked at to judge a length, pieces solved exactly at a time, and how often.
FILL, EXACT, WINDOWS = 64, 8, 24


def cost(length: int, fixed: float = 32.0, attention: float = 1 / 65536) -> float:
    """What a sequence costs: its tokens, a fixed part, and a part that grows with the square of its length."""
    return fixed + length + attention * length * length


def best_fit(sizes: list[int], lengths: list[int], opened: int | None) -> tuple[list[int], list[int], list[int], float]:
    """Bin and offset of each piece (sizes descending), each bin's final length, and the total cost, if bins are opened
    with `opened` tokens, or the least length that a larger piece needs; None: with the cheapest length each time."""
    room: list[int] = []  # distinct rooms, ascending
    open_at: dict[int, list[int]] = {}
    used: list[int] = []
    bins, offsets = [], []
    ascending = sizes[::-1]
    for size in sizes:
        ascending.pop()
        k = bisect_left(room, size)
        if k < len(room):
            left = room[k]
            b = open_at[left].pop()
            if not open_at[left]:
                del open_at[left]
                room.pop(k)
        else:
            b, left = len(used), cheapest_length(ascending, size, lengths) if opened is None else max(opened, lengths[bisect_left(lengths, size)])
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        left -= size
        if left:
            if left not in open_at:
                insort(room, left)
                open_at[left] = []
            open_at[left].append(b)
    final = [lengths[bisect_left(lengths, u)] for u in used]
    return bins, offsets, final, sum(map(cost, final))


def cheapest_length(left: list[int], size: int, lengths: list[int]) -> int:
    """The length to open for a piece: that whose bin, filled with what is left (ascending), costs least for a token."""
    best = None
    for c in lengths[bisect_left(lengths, size) :]:
        room, taken, k = c - size, [], len(left)
        while room and len(taken) < FILL and (k := bisect_right(left, room, 0, k)):
            k -= 1
            taken.append(left[k])
            room -= left[k]
        used = size + sum(taken)
        each = cost(lengths[bisect_left(lengths, used)]) / used
        if best is None or each <= best[0]:
            best = (each, c)
    return best[1]


def exact(sizes: list[int], lengths: list[int]) -> list[list[int]]:
    """The cheapest bins for a few pieces, by all their subsets; each bin as places in sizes."""
    n = len(sizes)
    total = [0] * (1 << n)
    for m in range(1, 1 << n):
        low = (m & -m).bit_length() - 1
        total[m] = total[m & (m - 1)] + sizes[low]
    price = [cost(lengths[bisect_left(lengths, t)]) if 0 < t <= lengths[-1] else float("inf") for t in total]
    best, take = [0.0] + [float("inf")] * ((1 << n) - 1), [0] * (1 << n)
    for m in range(1, 1 << n):
        first = m & -m
        rest = m ^ first
        s = rest
        while True:  # every bin that holds the first piece of m
            bin_ = s | first
            if (c := price[bin_] + best[m ^ bin_]) < best[m]:
                best[m], take[m] = c, bin_
            if not s:
                break
            s = (s - 1) & rest
    out, m = [], (1 << n) - 1
    while m:
        out.append([k for k in range(n) if take[m] >> k & 1])
        m ^= take[m]
    return out


def improve(sizes: list[int], bins: list[int], lengths: list[int]) -> list[int]:
    """The bins with the most room, as many as hold EXACT pieces together, are solved anew, some such sets in turn."""
    held: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        held.setdefault(b, []).append(i)
    room = {b: lengths[bisect_left(lengths, u)] - u for b, u in ((b, sum(sizes[i] for i in part)) for b, part in held.items())}
    order = sorted((b for b in held if room[b]), key=lambda b: (-room[b], b))
    out, k = list(bins), 0
    for _ in range(WINDOWS):
        window, pieces = [], []
        while k < len(order) and len(pieces) + len(held[order[k]]) <= EXACT:
            pieces += held[order[k]]
            window.append(order[k])
            k += 1
        if not window:
            if k < len(order):  # a bin of many pieces
                k += 1
                continue
            break
        found = exact([sizes[i] for i in pieces], lengths)
        price = lambda parts: sum(cost(lengths[bisect_left(lengths, sum(sizes[i] for i in p))]) for p in parts)
        new = [[pieces[i] for i in p] for p in found]
        if price(new) < price([held[b] for b in window]):
            for b, part in zip([*window, *range(max(out) + 1, max(out) + 1 + len(new))], new, strict=False):
                for i in part:
                    out[i] = b
    return out


def pack_group(sizes: list[int], lengths: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (sizes descending) and each bin's final length: the cheapest of the packing that
    chooses a length at each opening and those that open one length throughout, improved where much room is left."""
    tried = [best_fit(sizes, lengths, None), *(best_fit(sizes, lengths, c) for c in reversed(lengths))]
    bins = improve(sizes, min(tried, key=lambda t: t[3])[0], lengths)
    number = {b: k for k, b in enumerate(dict.fromkeys(bins))}
    used = [0] * len(number)
    offsets = []
    for size, b in zip(sizes, bins, strict=True):
        offsets.append(used[number[b]])
        used[number[b]] += size
    return [number[b] for b in bins], offsets, [lengths[bisect_left(lengths, u)] for u in used]


def pack(docs: DataFrame, lengths: tuple[int, ...] = (1024, 2048, 4096, 8192, 16384), tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece (from 0), first (its first token in the document), n_tokens, bin_id, capacity, at (its
    first token in the bin).

    tokens: how many tokens a row has; by default its UTF-8 bytes and one end token, as for a byte-level vocabulary.
    Every row is packed, also with a null or empty text (the end token alone), a null id, or as a repeated row; rows of
    no tokens at all are given one. Further columns are ignored. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    allowed = sorted(set(lengths))
    most = allowed[-1]
    n = F.greatest(F.lit(1), F.coalesce(tokens if tokens is not None else F.octet_length(text_col) + 1, F.lit(1))).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("salt"))  # copies of a row spread too
    rows = materialize(rows, "packing-sizes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    groups = max(1, round(total / GROUP_TOKENS))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {most} as int)")))).select(
        F.pmod(F.xxhash64("salt", "piece", F.lit("pack")), F.lit(groups)).cast("int").alias("g"),
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * most).alias("first"),
        F.least(F.lit(most), F.col("n") - F.col("piece").cast("long") * most).cast("int").alias("n_tokens"),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, final = pack_group(pdf["n_tokens"].tolist(), allowed)
        bins = np.array(bins, np.int64)
        return pdf.assign(bin_id=(pdf["g"].to_numpy(np.int64) << 32) + bins, capacity=np.array(final, np.int32)[bins], at=np.array(offsets, np.int32))[["doc_id", "piece", "first", "n_tokens", "bin_id", "capacity", "at"]]

    return pieces.groupBy("g").applyInPandas(run, "doc_id long, piece int, first long, n_tokens int, bin_id long, capacity int, at int")
