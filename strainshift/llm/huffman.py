"""Canonical length-limited Huffman coding of ids, in NumPy.

Codes are at most MAX_BITS long, so one look at a table of 2^MAX_BITS entries decodes a
symbol. The encoder notes the bit offset of every STRIDE-th id; the decoder runs all these
pieces of a block side by side, one id of each per step.
"""

from __future__ import annotations

import heapq

import numpy as np

MAX_BITS = 18
STRIDE = 128


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits per id, 0 for ids that do not occur; at most `limit`.

    Plain Huffman lengths first; codes over the limit are cut to it, and the shortest
    lengthening of the rarest shorter codes that makes the code sum right is applied.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    parent = np.zeros(2 * len(used) - 1, np.int64)
    heap = [(int(counts[s]), k) for k, s in enumerate(used)]
    heapq.heapify(heap)
    for node in range(len(used), 2 * len(used) - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        heapq.heappush(heap, (a + b, node))
    depth = np.zeros(2 * len(used) - 1, np.int64)
    for node in range(2 * len(used) - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    bits = np.minimum(depth[:len(used)], limit)
    room = (1 << limit) - int((1 << (limit - bits)).sum())
    order = np.lexsort((used, counts[used]))  # the rarest first
    while room < 0:
        for k in order:
            if bits[k] < limit:
                room += 1 << (limit - int(bits[k]) - 1)
                bits[k] += 1
                if room >= 0:
                    break
    for k in order[::-1]:  # room that is left shortens frequent codes
        while bits[k] > 1 and room >= 1 << (limit - int(bits[k])):
            room -= 1 << (limit - int(bits[k]))
            bits[k] -= 1
    lengths[used] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, counted up by (length, id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    limit = int(lengths.max(initial=0))
    step = np.uint64(1) << (limit - lengths[order].astype(np.int64)).astype(np.uint64)
    first = np.concatenate(([np.uint64(0)], np.cumsum(step)[:-1])) if len(order) else step
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = first >> (limit - lengths[order].astype(np.int64)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, bits) for every possible next `limit` bits."""
    limit = max(int(lengths.max(initial=0)), 1)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    fill = (1 << (limit - lengths[order].astype(np.int64)))
    ids, bits = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    spread = np.repeat(order, fill)
    ids[:len(spread)], bits[:len(spread)] = spread, lengths[spread]
    return ids, bits, limit


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' bits, most significant first, and the bit offset of each STRIDE-th id."""
    size = lengths[ids].astype(np.int64)
    if len(size) and size.min() == 0:
        raise ValueError("an id has no code")
    end = np.cumsum(size)
    start = end - size
    if not len(ids):
        return b"", start
    words = np.zeros((int(end[-1]) + 63) // 64 + 1, np.uint64)
    # Codes of one 64-bit word add up, as their bits differ; some run over into the next.
    code, room = codes[ids], 64 - (start & 63) - size
    over = np.flatnonzero(room < 0)
    here = code << np.maximum(room, 0).astype(np.uint64)
    here[over] = code[over] >> (-room[over]).astype(np.uint64)
    at = start >> 6
    head = np.flatnonzero(np.diff(at, prepend=-1))
    words[at[head]] = np.add.reduceat(here, head)
    words[at[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[:(int(end[-1]) + 7) // 8], start[::STRIDE]


def decode(data: bytes, n: int, checkpoints: np.ndarray, table) -> np.ndarray:
    """The n ids of a block."""
    ids, bits, limit = table
    raw = np.frombuffer(data + bytes(16 - len(data) % 8), ">u4").astype(np.uint64)
    pair = (raw[:-1] << np.uint64(32)) | raw[1:]
    lanes = len(checkpoints)
    out = np.zeros((STRIDE, lanes), np.uint32)
    at, mask = checkpoints.astype(np.int64).copy(), np.uint64((1 << limit) - 1)
    last = n - (lanes - 1) * STRIDE if lanes else 0
    for step in range(STRIDE):
        live = lanes if step < last else lanes - 1
        here = at[:live]
        look = (pair[here >> 5] >> (64 - limit - (here & 31)).astype(np.uint64)) & mask
        out[step, :live] = ids[look]
        here += bits[look]
    return out.T.reshape(-1)[:n]
