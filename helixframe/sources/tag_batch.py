"""Tags of many records to and from Arrow columns, all first tags at once, then all second ones, and so on.

What is rare (names or texts beyond ASCII, records of very many tags, anything malformed) is left to the codec of single tags.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from helixframe.sources.record_codec import tag_bytes, tag_items

FIELDS = ("name", "type", "subtype", "i", "f", "s", "ia", "fa")
_INTS = {"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4"}
_FORMS = {ord(k): np.dtype(v) for k, v in {**_INTS, "f": "<f4"}.items()}
_SIZE = np.zeros(256, np.int64)
for _k, _t in _FORMS.items():
    _SIZE[_k] = _t.itemsize
#: Tags of a record up to which they are taken side by side.
MOST = 64


class Rare(Exception):
    """Something for the codec of single tags."""


def _need(ok) -> None:
    if not ok:
        raise Rare


def within(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all items of spans, and where each span's begin among them."""
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return np.repeat(start - at[:-1], size) + np.arange(at[-1]), at


def _values(data: np.ndarray, at: np.ndarray, form: np.dtype) -> np.ndarray:
    """A number at each place."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(form.itemsize)]).view(form)[:, 0]


def _text(flat: np.ndarray, at: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    _need(at[-1] < 1 << 31 and not (flat > 127).any())
    valid = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat)), valid)


def decode_tags(data: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Tags of records whose bytes lie between start and stop; RecordError for what is malformed."""
    try:
        return _decode(data, start, stop, kind)
    except Rare:
        pass
    rows: list[tuple] = []
    ends = [0]
    for a, b in zip(start.tolist(), stop.tolist()):
        if a < b:
            rows.extend(tag_items(data[a:b].tobytes()))
        ends.append(len(rows))
    cols = list(zip(*rows)) or [()] * len(FIELDS)
    fields = [pa.array(c, kind.value_type.field(k).type) for c, k in zip(cols, FIELDS)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))


def _decode(data, start, stop, kind) -> pa.Array:
    now, who = start.copy(), np.flatnonzero(start < stop)
    zeros, places, owners, sizes = None, [], [], []
    for _ in range(MOST + 1):
        if not len(who):
            break
        at, end = now[who], stop[who]
        _need((at + 3 <= end).all())
        letter = data[at + 2]
        size = _SIZE[letter]
        size[letter == ord("A")] = 1
        if len(text := np.flatnonzero((letter == ord("Z")) | (letter == ord("H")))):
            if zeros is None:
                zeros = np.flatnonzero(data == 0)
            nth = np.searchsorted(zeros, at[text] + 3)
            _need((nth < len(zeros)).all())
            size[text] = zeros[nth] - at[text] - 2
        if len(many := np.flatnonzero(letter == ord("B"))):
            first = at[many] + 3
            _need((first + 5 <= end[many]).all())
            item, count = _SIZE[data[first]], _values(data, first + 1, np.dtype("<i4")).astype(np.int64)
            _need((item > 0).all() and (count >= 0).all())
            size[many] = 5 + item * count
        _need((size > 0).all() and (at + 3 + size <= end).all())
        places.append(at)
        owners.append(who)
        sizes.append(size)
        now[who] = at + 3 + size
        who = who[now[who] < end]
    _need(not len(who))
    at = np.concatenate([np.zeros(0, np.int64), *places])
    order = np.argsort(at, kind="stable")  # places grow with records and in them
    at, size = at[order], np.concatenate([np.zeros(0, np.int64), *sizes])[order]
    n = len(at)
    counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *owners]), minlength=len(start))
    letter, value = data[at + 2], at + 3
    whole, whole_ok = np.zeros(n, np.int64), np.zeros(n, bool)
    real, real_ok = np.zeros(n, np.float32), letter == ord("f")
    for k in np.unique(letter).tolist():
        if k in _FORMS:
            pick = np.flatnonzero(letter == k)
            numbers = _values(data, value[pick], _FORMS[k])
            if k == ord("f"):
                real[pick] = numbers
            else:
                whole[pick], whole_ok[pick] = numbers, True
    hexed, one = letter == ord("H"), letter == ord("A")
    _need(not ((size[hexed] - 1) % 2).any())
    shown = one | hexed | (letter == ord("Z"))
    take, cuts = within(value, np.where(one, 1, np.where(shown, size - 1, 0)))
    s = _text(data[take], cuts, ~shown)
    is_list = letter == ord("B")
    sub = np.where(is_list, data[np.minimum(value, len(data) - 1)], 0).astype(np.uint8) if n else np.zeros(0, np.uint8)
    subtype = _text(sub[is_list], np.concatenate([[0], np.cumsum(is_list)]), ~is_list)
    item = np.maximum(_SIZE[sub], 1)
    count = np.where(is_list, (size - 5) // item, 0)
    lists = []
    for mine, out in ((is_list & (sub != ord("f")), np.int64), (is_list & (sub == ord("f")), np.float32)):
        held = np.where(mine, count, 0)
        nth, cuts = within(np.zeros(n, np.int64), held)
        place, of = np.repeat(value + 5, held) + nth * np.repeat(item, held), np.repeat(sub, held)
        numbers = np.zeros(len(nth), out)
        for k in np.unique(of).tolist():
            pick = np.flatnonzero(of == k)
            numbers[pick] = _values(data, place[pick], _FORMS[k])
        lists.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(numbers), mask=pa.array(~mine)))
    names = _text(data[at[:, None] + np.arange(2)].reshape(-1), 2 * np.arange(n + 1))
    types = _text(letter, np.arange(n + 1))
    cols = [names, types, subtype, pa.array(whole, mask=~whole_ok), pa.array(real, mask=~real_ok), s, *lists]
    fields = [c.cast(kind.value_type.field(k).type) for c, k in zip(cols, FIELDS)]
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))


def flat_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column, and where its items begin and how long they are; null is empty."""
    col = col.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)


def unpacked(name: str, kind: str, value: str) -> tuple:
    """A tag, in the order of FIELDS, from its packed form (functions.tags.packed)."""
    letter, sub = kind[:1], kind[1:] or None
    i = int(value) if letter in _INTS else None
    f = float(value) if letter == "f" else None
    s = value if letter not in _INTS and letter not in ("f", "B") else None
    items = value.split(",") if value else []
    ia = [int(x) for x in items] if letter == "B" and sub != "f" else None
    return name, letter, sub, i, f, s, ia, [float(x) for x in items] if letter == "B" and sub == "f" else None


def unpack(text: str | None) -> list[dict]:
    """Tags of a record from their packed form."""
    parts = text.split("\0") if text else []
    return [dict(zip(FIELDS, unpacked(*x))) for x in zip(parts[::3], parts[1::3], parts[2::3])]


#: Values up to this long are kept with their bytes, as they come again and again.
SHORT = 12


def _bytes_of(name: str, kind: str, value: str) -> bytes:
    return tag_bytes(*unpacked(name, kind, value))


_kept_bytes = lru_cache(1 << 16)(_bytes_of)


def _one(name: str, kind: str, value: str) -> bytes:
    return _kept_bytes(name, kind, value) if len(value) <= SHORT else _bytes_of(name, kind, value)


def _encode_packed(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raws = []
    for text in col.to_pylist():
        parts = text.split("\0") if text else []
        raws.append(b"".join(map(_one, parts[::3], parts[1::3], parts[2::3])))
    return np.frombuffer(b"".join(raws), np.uint8), np.fromiter(map(len, raws), np.int64, len(raws))


def encode_tags(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all records' tags, and how many each record has; RecordError for what doesn't fit."""
    if pa.types.is_string(col.type):
        return _encode_packed(col)
    lists = col.fill_null([]) if col.null_count else col
    ends = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    fields = lists.flatten().flatten()
    try:
        flat, size = _encode(dict(zip(FIELDS, fields)), int(ends[-1]))
    except Rare:
        parts = [tag_bytes(*x) for x in zip(*(f.to_pylist() for f in fields))]
        flat, size = np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.concatenate([[0], np.cumsum(size)])
    return flat, at[ends[1:]] - at[ends[:-1]]


def _fits(numbers: np.ndarray, form: np.dtype) -> None:
    info = np.iinfo(form)
    _need(not len(numbers) or numbers.min() >= info.min and numbers.max() <= info.max)


def _encode(cols: dict[str, pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _need(not cols["name"].null_count and not cols["type"].null_count)
    name, name_at, name_n = flat_text(cols["name"])
    kind, kind_at, kind_n = flat_text(cols["type"])
    _need((name_n == 2).all() and (kind_n == 1).all())
    head, letter = name[name_at[:, None] + np.arange(2)], kind[kind_at]
    _need(not (head > 127).any() and not (letter > 127).any())
    size, found = np.zeros(n, np.int64), {k: np.flatnonzero(letter == k) for k in np.unique(letter).tolist()}
    texts = np.concatenate([np.zeros(0, np.int64), *(found[k] for k in map(ord, "AZH") if k in found)])
    if len(texts):
        own = cols["s"].take(pa.array(np.sort(texts)))
        texts = np.sort(texts)
        _need(not own.null_count)
        text, text_at, text_n = flat_text(own)
        one = letter[texts] == ord("A")
        _need((text_n[one] == 1).all() and not (text_n[letter[texts] == ord("H")] % 2).any())
        take, _ = within(text_at, text_n)
        chars = text[take]
        _need(not (chars == 0).any() and not (chars > 127).any())
        size[texts] = text_n + ~one
    put: list[tuple[np.ndarray, np.ndarray]] = []  # tags, and a row of bytes for each
    for k, tags in found.items():
        if k in _FORMS:
            mine = cols["f" if k == ord("f") else "i"].take(pa.array(tags))
            _need(not mine.null_count)
            numbers = mine.to_numpy(zero_copy_only=False)
            if k != ord("f"):
                _fits(numbers, _FORMS[k])
            put.append((tags, np.ascontiguousarray(numbers.astype(_FORMS[k])).view(np.uint8).reshape(len(tags), -1)))
            size[tags] = _SIZE[k]
        elif k == ord("B"):
            subs = cols["subtype"].take(pa.array(tags))
            _need(not subs.null_count)
            sub, sub_at, sub_n = flat_text(subs)
            _need((sub_n == 1).all())
            sub = sub[sub_at]
            arrays = []
            for j in np.unique(sub).tolist():
                _need(j in _FORMS)
                those = tags[sub == j]
                values = cols["fa" if j == ord("f") else "ia"].take(pa.array(those))
                _need(not values.null_count)
                count = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
                items = values.flatten()
                _need(not items.null_count)
                numbers = items.to_numpy(zero_copy_only=False)
                if j != ord("f"):
                    _fits(numbers, _FORMS[j])
                arrays.append((those, j, count, np.ascontiguousarray(numbers.astype(_FORMS[j])).view(np.uint8)))
                size[those] = 5 + count * _SIZE[j]
        else:
            _need(k in map(ord, "AZH"))
    at = np.concatenate([[0], np.cumsum(size + 3)])
    out = np.zeros(at[-1], np.uint8)
    at = at[:-1]
    out[at[:, None] + np.arange(2)] = head
    out[at + 2] = letter
    for tags, raw in put:
        out[at[tags][:, None] + 3 + np.arange(raw.shape[1])] = raw
    if len(texts):
        out[within(at[texts] + 3, text_n)[0]] = chars
    if ord("B") in found:
        for those, j, count, raw in arrays:
            to = at[those] + 3
            out[to] = j
            out[to[:, None] + 1 + np.arange(4)] = count.astype("<i4").view(np.uint8).reshape(-1, 4)
            out[within(to + 5, count * _SIZE[j])[0]] = raw
    return out, size + 3
