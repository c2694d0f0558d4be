"""Progressive JPEG: a decoder to coefficients and RGB tensors, an exact coefficient writer, and the column operators.

Decoding runs many images at once.  Every restart segment of every scan is a
*lane* with its own bit position; all lanes of a phase advance together, one
symbol a step, in numpy.  Scans of one image that touch the same component are
in successive phases, so refinement scans find the coefficients they refine.

The lossless unit of a JPEG is its quantised coefficient, so the writer stores
one byte of payload as one coefficient of a 4:2:0 image: the components'
blocks, in raster order, hold the payload in order.  A byte's rank in a fixed
order (frequent ones first) sets its coefficient, 2, -2, 3, -3 and so on, so
frequent bytes have short codes and none is zero.  It uses spectral selection
(DC, 1-5, 6-63) and successive approximation (all but the last bit, then the
last bit), with restart segments as lanes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcore import column_bytes, row_slices, stored

UNIT = 192
RESTART = 8
ACROSS = 64  # MCUs side by side at most
COMPONENTS = ((1, 2, 2), (2, 1, 1), (3, 1, 1))  # id, horizontal and vertical sampling

# The zigzag order of the JPEG standard, by the rule of its anti-diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8) if (p // 8 + p % 8) % 2 else (p % 8))))

# Bytes by rank.  Common ones of texts, other printable ones, those of longer UTF-8 characters, the rest.
COMMON = b" etaoinshrdlcumwfgypbvk.,\n"
BY_RANK = np.array(list(dict.fromkeys([*COMMON, *range(33, 127), *range(128, 256), *range(128)])), np.uint8)
LEVEL = np.zeros(256, np.int64)
LEVEL[BY_RANK] = (2 + np.arange(256) // 2) * np.where(np.arange(256) % 2, -1, 1)

DC_LENGTHS = {s: 4 for s in range(12)}
AC_LENGTHS = {0x01: 1, 0x02: 2, 0x03: 3, 0x04: 4, 0x05: 5, 0x06: 6, 0x07: 8} | {run: 9 for run in range(0x00, 0x40, 0x10)}


def canonical(lengths: dict[int, int]) -> tuple[dict[int, tuple[int, int]], bytes]:
    """({symbol: (code, length)}, the body of a DHT segment without its class byte)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    counts = [sum(v == n for v in lengths.values()) for n in range(1, 17)]
    return codes, bytes(counts) + bytes(order)


DC_CODES, DC_BODY = canonical(DC_LENGTHS)
AC_CODES, AC_BODY = canonical(AC_LENGTHS)


@lru_cache(64)
def lookup(body: bytes) -> np.ndarray:
    """length << 8 | symbol, by the next 16 bits; length 0 for no code."""
    out = np.zeros(65536, np.uint16)
    code, at = 0, 16
    for n in range(1, 17):
        for s in body[at : at + body[n - 1]]:
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
            code += 1
        at += body[n - 1]
        code <<= 1
    return out


@lru_cache(2)
def inverse_matrix(kind) -> np.ndarray:
    """(zigzag coefficient x sample) inverse DCT times 2**12, as whole numbers."""
    i = np.arange(8)
    c = np.where(i == 0, np.sqrt(0.5), 1.0)
    one = c[:, None] * np.cos((2 * i[None, :] + 1) * i[:, None] * np.pi / 16) / 2
    full = np.einsum("vy,ux->vuyx", one, one).reshape(64, 64)
    return np.round(full[ZIGZAG] * 2**12).astype(kind)


def samples_of(coef: np.ndarray) -> np.ndarray:
    """(n x 64) samples of dequantised (n x 64) coefficients.  The products and sums are whole numbers that the float type
    holds exactly, so equal blocks give equal samples however they are batched."""
    exact = len(coef) and int(np.abs(coef).sum(1, dtype=np.int64).max()) * 1024 < 2**24
    kind = np.float32 if exact else np.float64
    out = coef.astype(kind) @ inverse_matrix(kind)
    return np.clip((out.astype(np.int32) + 2**11 >> 12) + 128, 0, 255)


# ---- writing ----


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def layout(n_bytes: int) -> tuple[int, int]:
    """(MCUs across, MCUs down) of an image that holds ``n_bytes`` coefficients."""
    mcus = max(1, -(-n_bytes // 384))
    across = min(mcus, max(ACROSS, -(-mcus // 4095)))
    return across, -(-mcus // across)


def pack_bits(value: np.ndarray, length: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each lane and the end): items of at most 17 bits, each lane filled up with ones."""
    bits = np.bincount(lane, weights=length, minlength=lanes).astype(np.int64)
    border = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    run = np.cumsum(length) - length
    first = np.concatenate([[0], np.cumsum(bits)])[:-1]
    pos = run - first[lane] + border[lane] * 8
    word = value.astype(np.int64) << (24 - (pos & 7) - length)
    total = int(border[-1]) + 1
    # items that begin in the same byte have no bits in common: their 24-bit words add up
    sums = np.bincount(pos >> 3, weights=word, minlength=total).astype(np.int64)
    wide = np.zeros(total + 2, np.int64)
    for i in range(3):
        wide[i : i + total] += (sums >> (16 - 8 * i)) & 255
    out = wide[: total - 1].astype(np.uint8)
    pad = (border[1:] * 8 - (border[:-1] * 8 + bits)).astype(np.int64)
    filled = np.flatnonzero(pad)
    out[border[1:][filled] - 1] |= ((1 << pad[filled]) - 1).astype(np.uint8)
    return out, border


def stuffed(data: np.ndarray, border: np.ndarray, number: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte stuffing, and a restart marker after each lane that doesn't close its scan; (bytes, lane borders)."""
    ff = data == 0xFF
    shift = np.concatenate([[0], np.cumsum(ff)])
    marks = np.concatenate([[0], np.cumsum(~closes)])
    starts = border[:-1] + shift[border[:-1]] + 2 * marks[:-1]
    lane = np.repeat(np.arange(len(number)), np.diff(border))
    size = int(len(data) + shift[-1] + 2 * marks[-1])
    out = np.zeros(size, np.uint8)
    out[np.arange(len(data)) + shift[:-1] + 2 * marks[lane]] = data
    ends = border[1:] + shift[border[1:]] + 2 * marks[:-1]
    go = np.flatnonzero(~closes)
    out[ends[go]] = 0xFF
    out[ends[go] + 1] = 0xD0 + number[go] % 8
    return out, np.append(starts, size)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One progressive JPEG a payload, holding it exactly."""
    if not payloads:
        return []
    shapes = [layout(len(p)) for p in payloads]
    coded = [np.frombuffer(p.ljust(a * d * 384), np.uint8) for p, (a, d) in zip(payloads, shapes, strict=True)]
    sizes = np.array([len(c) // 64 for c in coded])  # blocks of each image: 4/6 luma, 1/6 and 1/6 chroma
    v = LEVEL[np.concatenate(coded).reshape(-1, 64)]
    mcus = sizes // 6
    part_sizes = np.stack([mcus * 4, mcus, mcus], 1).reshape(-1)  # blocks of (image, component)
    part = np.repeat(np.arange(len(part_sizes)), part_sizes)
    inside = np.arange(len(v)) - np.repeat(np.cumsum(part_sizes) - part_sizes, part_sizes)
    lanes_of = -(-part_sizes // RESTART)
    lane_base = np.cumsum(lanes_of) - lanes_of
    lane = lane_base[part] + inside // RESTART
    n_lanes = int(lanes_of.sum())
    number = np.arange(n_lanes) - np.repeat(lane_base, lanes_of)
    closes = number == np.repeat(lanes_of, lanes_of) - 1
    blocks_in = np.bincount(lane, minlength=n_lanes)
    # DC shifts arithmetically, AC by magnitude
    low = np.abs(v) & 1
    high = np.abs(v) >> 1
    dc = v[:, 0] >> 1
    minus = v < 0
    table = np.zeros((3, 12), np.int64), np.zeros((3, 12), np.int64)
    for s in range(12):
        table[0][0, s], table[1][0, s] = DC_CODES[s]
        if s in AC_CODES and s:
            table[0][1, s], table[1][1, s] = AC_CODES[s]

    def finish(value, length, of):
        data, border = pack_bits(value, length, of, n_lanes)
        out, borders = stuffed(data, border, number, closes)
        raw = out.tobytes()
        ends = np.append(borders[lane_base], len(out))
        return [raw[ends[i] : ends[i + 1]] for i in range(len(part_sizes))]

    bit_size = np.frompyfunc(int.bit_length, 1, 1)
    sizes_of = np.array([int(bit_size(i)) for i in range(512)])
    fresh = inside % RESTART == 0
    diff = dc - np.where(fresh, 0, np.concatenate([[0], dc[:-1]]))
    s = sizes_of[np.abs(diff)]
    scans = [(0, 0, 0, 1, finish(table[0][0][s] << s | np.where(diff < 0, diff + (1 << s) - 1, diff), table[1][0][s] + s, lane))]
    for lo, hi in ((1, 5), (6, 63)):
        band = high[:, lo : hi + 1].reshape(-1)
        s = sizes_of[band]
        coded_band = np.where(minus[:, lo : hi + 1].reshape(-1), (1 << s) - 1 - band, band)
        scans.append((lo, hi, 0, 1, finish(table[0][1][s] << s | coded_band, table[1][1][s] + s, np.repeat(lane, hi - lo + 1))))
    scans.append((0, 0, 1, 0, finish(v[:, 0] & 1, np.ones(len(low), np.int64), lane)))
    # refinement of 1-63: one end-of-band run over the lane's blocks, then a correction bit for each coefficient
    run = sizes_of[blocks_in] - 1
    codes = np.array([AC_CODES[r << 4] for r in range(4)])
    value = np.zeros((len(v), 64), np.int64)
    length = np.ones((len(v), 64), np.int64)
    value[:, 1:] = low[:, 1:]
    length[:, 0] = 0
    head = np.flatnonzero(fresh)
    r = run[lane[head]]
    value[head, 0] = codes[r, 0] << r | (blocks_in[lane[head]] - (1 << r))
    length[head, 0] = codes[r, 1] + r
    scans.append((1, 63, 1, 0, finish(value.reshape(-1), length.reshape(-1), np.repeat(lane, 64))))

    tables = segment(0xDB, b"\x00" + b"\x01" * 64) + segment(0xC4, b"\x00" + DC_BODY + b"\x10" + AC_BODY) + segment(0xDD, struct.pack(">H", RESTART))
    out = []
    for i, (p, (across, down)) in enumerate(zip(payloads, shapes, strict=True)):
        frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + b"".join(bytes([c, h << 4 | w, 0]) for c, h, w in COMPONENTS)
        parts = [b"\xff\xd8", tables, segment(0xFE, b"bytes=%d" % len(p)), segment(0xC2, frame)]
        for lo, hi, ah, al, data in scans:
            for c in range(3):
                parts += [segment(0xDA, bytes([1, COMPONENTS[c][0], 0, lo, hi, ah << 4 | al])), data[3 * i + c]]
        parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
    return out


# ---- reading ----


class Image:
    """Headers of one progressive JPEG: frame, components, scans with their restart segments, comment."""

    def __init__(self, data: bytes):
        self.width = self.height = self.restart = 0
        self.components: list[dict] = []
        self.scans: list[dict] = []
        self.quant: dict[int, np.ndarray] = {}
        self.comment = b""
        tables: dict[int, bytes] = {}
        b = np.frombuffer(data, np.uint8)
        ff = np.flatnonzero(b[:-1] == 0xFF)
        after = b[ff + 1]
        stops = ff[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
        restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            m = data[at + 1]
            if m == 0xD9:
                break
            if m == 0xFF:
                at += 1
                continue
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if m == 0xDB:
                while body:
                    wide = body[0] >> 4
                    size = 128 if wide else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + size :]
            elif m == 0xC4:
                while body:
                    size = 16 + sum(body[1:17])
                    tables[body[0]] = bytes(body[1 : 1 + size])
                    body = body[1 + size :]
            elif m == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif m == 0xFE:
                self.comment = bytes(body)
            elif m == 0xC2:
                _, self.height, self.width, k = struct.unpack(">BHHB", body[:6])
                self.components = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(k)]
            elif 0xC0 <= m <= 0xCF and m not in (0xC8, 0xCC):
                raise ValueError("not a progressive Huffman JPEG")
            elif m == 0xDA:
                k = body[0]
                named = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(k)]
                place = {c["id"]: i for i, c in enumerate(self.components)}
                lo, hi, a = body[1 + 2 * k : 4 + 2 * k]
                i = int(np.searchsorted(stops, at))
                end = int(stops[i]) if i < len(stops) else len(data)
                inner = restarts[np.searchsorted(restarts, at) : np.searchsorted(restarts, end)]
                self.scans.append({"components": [place[x] for x, _ in named], "lo": lo, "hi": hi, "ah": a >> 4, "al": a & 15, "starts": np.concatenate([[at], inner + 2]), "ends": np.append(inner, end), "dc": [tables.get(t >> 4) for _, t in named], "ac": [tables.get(0x10 | t & 15) for _, t in named], "restart": self.restart})
                at = end
        if not self.components or not self.width or not self.height:
            raise ValueError("no frame")
        hm, vm = max(c["h"] for c in self.components), max(c["v"] for c in self.components)
        self.across, self.down = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        for c in self.components:
            c["stride"], c["rows"] = self.across * c["h"], self.down * c["v"]
            c["bw"], c["bh"] = -(-(-(-self.width * c["h"] // hm)) // 8), -(-(-(-self.height * c["v"] // vm)) // 8)
        self.hm, self.vm = hm, vm

    def order(self, scan: dict, bases: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """(storage index, place in the scan's component list) of blocks in coding order; blocks an MCU."""
        cs = scan["components"]
        if len(cs) == 1:
            c = self.components[cs[0]]
            y, x = np.divmod(np.arange(c["bw"] * c["bh"]), c["bw"])
            return bases[cs[0]] + y * c["stride"] + x, np.zeros(len(y), np.int64), 1
        my, mx = np.divmod(np.arange(self.across * self.down), self.across)
        cols, who = [], []
        for j, i in enumerate(cs):
            c = self.components[i]
            for y in range(c["v"]):
                for x in range(c["h"]):
                    cols.append(bases[i] + (my * c["v"] + y) * c["stride"] + mx * c["h"] + x)
                    who.append(j)
        return np.stack(cols, 1).reshape(-1), np.tile(who, len(my)), len(who)


class Lanes:
    """Parallel bit readers over one buffer."""

    def __init__(self, data: np.ndarray, bit: np.ndarray):
        d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.window = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
        self.last = len(self.window) - 1
        self.bit = bit.astype(np.int64)

    def peek(self, lanes: np.ndarray, n) -> np.ndarray:
        p = self.bit[lanes]
        w = self.window[np.minimum(p >> 3, self.last)] << (p & 7).astype(np.uint32)
        return np.where(n > 0, w.astype(np.int64) >> (32 - np.maximum(n, 1)), 0)

    def read(self, lanes: np.ndarray, n) -> np.ndarray:
        out = self.peek(lanes, n)
        self.bit[lanes] += n
        return out

    def symbol(self, lanes: np.ndarray, table: np.ndarray, which: np.ndarray) -> np.ndarray:
        got = table[which, self.peek(lanes, 16)]
        if not got.all():
            raise ValueError("bad Huffman code")
        self.bit[lanes] += got >> 8
        return (got & 255).astype(np.int64)


def extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where((s > 0) & (v < (1 << np.maximum(s - 1, 0))), v - (1 << s) + 1, v)


def decode_coefficients(images: list[Image], files: list[bytes]) -> list[list[np.ndarray]]:
    """For each image, for each component: (rows, stride, 64) int16 in zigzag order."""
    bases, total = [], 0
    for im in images:
        bases.append([])
        for c in im.components:
            bases[-1].append(total)
            total += c["rows"] * c["stride"]
    coef = np.zeros((total, 64), np.int16)
    data = np.frombuffer(b"".join(files), np.uint8)
    file_at = np.concatenate([[0], np.cumsum([len(f) for f in files])]).astype(np.int64)
    keep = np.ones(len(data), bool)
    keep[1:] = ~((data[1:] == 0) & (data[:-1] == 0xFF))
    place = np.concatenate([[0], np.cumsum(keep)])
    phases: list[list[tuple[int, dict]]] = []
    for i, im in enumerate(images):
        depth = [0] * len(im.components)
        for scan in im.scans:
            k = max(depth[c] for c in scan["components"])
            for c in scan["components"]:
                depth[c] = k + 1
            while len(phases) <= k:
                phases.append([])
            phases[k].append((i, scan))
    plain = data[keep]
    for phase in phases:
        for kind in ("dc", "ac"):
            for refine in (False, True):
                chosen = [(i, s) for i, s in phase if (s["lo"] == 0) == (kind == "dc") and (s["ah"] > 0) == refine]
                if chosen:
                    run_scans(kind, refine, chosen, images, bases, plain, file_at, place, coef)
    return [[coef[b : b + c["rows"] * c["stride"]].reshape(c["rows"], c["stride"], 64) for b, c in zip(bs, im.components, strict=True)] for bs, im in zip(bases, images, strict=True)]


def run_scans(kind, refine, chosen, images, bases, plain, file_at, place, coef) -> None:
    orders, whos, tabs, names = [], [], [], {}
    starts, first, last, lo, hi, al = [], [], [], [], [], []
    at = 0
    for i, s in chosen:
        order, who, unit = images[i].order(s, bases[i])
        tab = np.array([names.setdefault(t, len(names)) if t else 0 for t in s[kind]])
        orders.append(order)
        whos.append(who)
        tabs.append(tab[who])
        n = len(s["starts"])
        step = s["restart"] * unit if s["restart"] else len(order)
        f = np.minimum(np.arange(n) * step, len(order))
        starts.append(place[file_at[i] + s["starts"]] * 8)
        first.append(at + f)
        last.append(at + (np.append(f[1:], len(order)) if n > 1 else np.array([len(order)])))
        for x, v in ((lo, s["lo"]), (hi, s["hi"]), (al, s["al"])):
            x.append(np.full(n, v))
        at += len(order)
    order, who, tab = np.concatenate(orders), np.concatenate(whos), np.concatenate(tabs)
    now, last, lo, hi, al = (np.concatenate(x) for x in (first, last, lo, hi, al))
    now = now.copy()
    lanes = Lanes(plain, np.concatenate(starts))
    table = np.stack([lookup(t) for t in names]) if names else np.zeros((1, 65536), np.uint16)
    live = np.flatnonzero(now < last)
    if kind == "dc":
        pred = np.zeros((len(now), 4), np.int64)
        while len(live):
            b = now[live]
            if refine:
                coef[order[b], 0] |= (lanes.read(live, 1) << al[live]).astype(np.int16)
            else:
                s = lanes.symbol(live, table, tab[b])
                pred[live, who[b]] += extend(lanes.read(live, s), s)
                coef[order[b], 0] = pred[live, who[b]] << al[live]
            now[live] += 1
            live = live[now[live] < last[live]]
        return
    k, run = lo.copy(), np.zeros(len(now), np.int64)
    if refine:
        while len(live):
            over = refine_step(live, lanes, table, tab, order, now, k, run, hi, al, coef)
            done = live[over]
            now[done] += 1
            k[done] = lo[done]
            live = live[now[live] < last[live]]
        return
    first_pass(lanes, table, tab[now[live]], order, now[live], last[live], lo[live], hi[live], al[live], lanes.bit[live], coef.reshape(-1))


def first_pass(lanes: Lanes, table, which, order, now, last, lo, hi, al, bit, flat) -> None:
    """AC bands of all lanes, one symbol a step; the state is compact and shrinks as lanes end."""
    k, run, base = lo.copy(), np.zeros(len(now), np.int64), order[now] * 64
    one = table[0] if len(table) == 1 else None
    while len(now):
        word = lanes.window[bit >> 3] << (bit & 7).astype(np.uint32)
        got = one[word >> 16] if one is not None else table[which, word >> 16]
        n, s, r = (got >> 8).astype(np.uint32), (got & 15).astype(np.uint32), (got >> 4 & 15).astype(np.int64)
        idle = run > 0
        any_idle = idle.any()
        if not (n > 0 if not any_idle else (n > 0) | idle).all():
            raise ValueError("bad Huffman code")
        extra = np.where(s > 0, s, np.where(r < 15, r, 0).astype(np.uint32))
        if int((n + extra).max()) <= 25:
            v = ((word << n) >> np.uint32(1) >> (np.uint32(31) - extra)).astype(np.int64)
        else:
            at = bit + n
            v = ((lanes.window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(1) >> (np.uint32(31) - extra)).astype(np.int64)
        step = (n + extra).astype(np.int64)
        if any_idle:
            step[idle] = 0
            s = np.where(idle, 0, s)
            r = np.where(idle, 0, r)
        bit = bit + step
        kk = k + r
        some = s > 0
        size = s.astype(np.int64)
        v_signed = np.where(v < (np.int64(1) << np.maximum(size - 1, 0)), v - (np.int64(1) << size) + 1, v)
        if some.all():
            if (kk > 63).any():
                raise ValueError("coefficient past the block")
            flat[base + kk] = v_signed << al
            k = kk + 1
            over = k > hi
        else:
            if (kk[some] > 63).any():
                raise ValueError("coefficient past the block")
            flat[base[some] + kk[some]] = v_signed[some] << al[some]
            end = ~some & (r < 15)
            opens = end & ~idle
            run = np.where(idle, run - 1, np.where(opens, (np.int64(1) << r) - 1 + v, run))
            k = kk + 1
            over = end | (k > hi)
        if over.any():
            now = now + over
            k = np.where(over, lo, k)
            go = now < last
            if not go.all():
                which, now, last, lo, hi, al, bit, k, run = (x[go] for x in (which, now, last, lo, hi, al, bit, k, run))
            base = order[now] * 64


def refine_step(live, lanes, table, tab, order, now, k, run, hi, al, coef) -> np.ndarray:
    """One symbol of an AC refinement scan for each lane; tells which lanes end their block."""
    b = order[now[live]]
    block = coef[b].astype(np.int64)
    idx = np.arange(64)
    old = block != 0
    r, fresh, ending = np.full(len(live), 99), np.zeros(len(live), np.int64), run[live] > 0
    a = np.flatnonzero(~ending)
    if len(a):
        rs = lanes.symbol(live[a], table, tab[now[live[a]]])
        rr, s = rs >> 4, rs & 15
        end = (s == 0) & (rr < 15)
        run[live[a[end]]] = (1 << rr[end]) + lanes.read(live[a[end]], rr[end])
        ending[a[end]] = True
        go = a[~end]
        r[go] = rr[~end]
        new = a[s > 0]
        fresh[new] = np.where(lanes.read(live[new], 1) > 0, 1, -1)
    span = (idx >= k[live][:, None]) & (idx <= hi[live][:, None])
    zeros = np.cumsum(span & ~old, axis=1)
    # the place where r zeros have been passed and one more stands, or the end of the band
    hit = (zeros == r[:, None] + 1) & span & ~old
    target = np.where(hit.any(1), hit.argmax(1), hi[live] + 1)
    fix = span & old & (idx < target[:, None])
    row, col = np.nonzero(fix)
    if len(row):
        rank = np.cumsum(fix, axis=1)[row, col] - 1
        p = lanes.bit[live[row]] + rank
        on = (lanes.window[np.minimum(p >> 3, lanes.last)] >> (31 - (p & 7)).astype(np.uint32)) & 1
        grow = np.flatnonzero(on)
        val = block[row[grow], col[grow]]
        coef[b[row[grow]], col[grow]] = val + np.sign(val) * (1 << al[live[row[grow]]])
        lanes.bit[live] += fix.sum(1)
    put = np.flatnonzero((fresh != 0) & (target <= hi[live]))
    coef[b[put], target[put]] = fresh[put] << al[live[put]]
    k[live] = target + 1
    run[live[ending]] -= 1
    return ending | (k[live] > hi[live])


def rgb_tensor(im: Image, planes: list[np.ndarray]) -> np.ndarray:
    """(height, width, 3) uint8: inverse transform, chroma by repetition to full resolution, YCbCr to RGB in fixed point.
    One component gives equal channels."""
    full = []
    for c, coef in zip(im.components, planes, strict=True):
        q = im.quant.get(c["q"], np.ones(64, np.int64))
        samples = samples_of(coef.reshape(-1, 64) * q.astype(np.int32))
        flat = samples.reshape(c["rows"], c["stride"], 8, 8).transpose(0, 2, 1, 3).reshape(c["rows"] * 8, c["stride"] * 8)
        full.append(flat.repeat(im.vm // c["v"], 0).repeat(im.hm // c["h"], 1)[: im.height, : im.width])
    if len(full) < 3:
        return np.stack([full[0]] * 3, -1).astype(np.uint8)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    half = 1 << 15
    r, g, b = y + ((91881 * cr + half) >> 16), y - ((22554 * cb + 46802 * cr + half) >> 16), y + ((116130 * cb + half) >> 16)
    return np.clip(np.stack([r, g, b], -1), 0, 255).astype(np.uint8)


def payload_of(im: Image, planes: list[np.ndarray]) -> bytes:
    """The payload an image from encode_payloads holds."""
    flat = np.concatenate([p.reshape(-1) for p in planes])
    return BY_RANK[(np.abs(flat) - 2) * 2 + (flat < 0)].tobytes()[: int(im.comment.removeprefix(b"bytes="))]


def padded(text: bytes) -> bytes:
    n = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text + b" " * (n - len(text))


def decode_media(rows: DataFrame, key: str, media: str = "media") -> DataFrame:
    """(key, height, width, rgb binary, error) of a column of progressive JPEGs.

    ``rgb`` is the height x width x 3 tensor, row by row.  A null or broken file, or one that is not progressive, gives
    null tensor and the reason in ``error``; it doesn't fail the job.
    """
    schema = T.StructType([rows.schema[key], T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in row_slices(b, media, 64):
                out = []
                for x in part.column(1).to_pylist():
                    try:
                        im = Image(x or b"")
                        t = rgb_tensor(im, decode_coefficients([im], [x])[0])
                        out.append((*t.shape[:2], t.tobytes(), None))
                    except (ValueError, IndexError, struct.error, KeyError) as e:
                        out.append((None, None, None, str(e) or "broken"))
                h, w, t, e = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(t, pa.binary()), pa.array(e, pa.string())], names=schema.names)

    return rows.select(key, media).mapInArrow(run, schema)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media binary): each whole text, filled up as text_media says, as a progressive JPEG."""
    schema = T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in row_slices(b, "text", 1024, 1 << 20):
                raw, offsets = column_bytes(part.column(1))
                whole = raw.tobytes()
                files = encode_payloads([padded(whole[i:j]) for i, j in zip(offsets, offsets[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(files, pa.binary())], names=schema.names)

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)


def read_media(media: DataFrame, key: str = "doc_id", keep_media: bool = False) -> DataFrame:
    """Payloads and features of a table made by encode_texts(); columns as text_media()."""
    fields = [media.schema[key], *(T.StructField(n, t()) for n, t in (("n_bytes", T.LongType), ("payload_bytes", T.LongType), ("payload_sha256", T.StringType), ("tail_crc32", T.LongType), ("media_bytes", T.LongType), ("media_sha256", T.StringType), ("feature", T.StringType)))]
    if keep_media:
        fields += [T.StructField("media", T.BinaryType()), T.StructField("rgb", T.BinaryType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in row_slices(b, "media", 1024, 3 << 18):
                files = part.column(2).to_pylist()
                images = [Image(f) for f in files]
                out = []
                for f, im, planes in zip(files, images, decode_coefficients(images, files), strict=True):
                    back = payload_of(im, planes)
                    rgb = rgb_tensor(im, planes)
                    means = rgb.reshape(-1, 3).mean(0)
                    feature = f"{im.height}x{im.width}x3 {means[0]:.4f} {means[1]:.4f} {means[2]:.4f} {zlib.crc32(rgb):08x}"
                    row = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature)
                    out.append((*row, f, rgb.tobytes()) if keep_media else row)
                cols = [pa.array(c, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[s.dataType.typeName()]) for c, s in zip(zip(*out, strict=True), fields[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=schema.names)

    return media.select(key, "n_bytes", "media").mapInArrow(run, schema)


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each whole text as a progressive JPEG, read the stored table back, decode it; one row per input row.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the payload read back), media_bytes,
    media_sha256, feature (tensor shape, channel means and CRC).  The media are a table in the shared folder.  With
    ``keep_media`` the result has media and rgb, the full-resolution tensor, too; it is then the caller's to store, so no
    table of media is made on the way.  The payload is the UTF-8 text filled up with
    spaces to a positive multiple of 192 bytes; a null text is empty.  A null key is kept, rows that repeat give equal
    rows, an empty table gives none, other columns are ignored.
    """
    media = encode_texts(docs, key, text)
    return read_media(media if keep_media else stored(media, "media"), key, keep_media)
