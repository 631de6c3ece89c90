"""Headers: ordered lines of typed entries or comments, and the references they name."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

# Types of header lines.
TYPES = ("HD", "SQ", "RG", "PG")


class HeaderError(ValueError):
    """A header that breaks its format."""


class Entry:
    """A typed line: tags in order; a name may occur twice."""

    def __init__(self, kind: str, tags: list[tuple[str, str]] | None = None):
        if kind not in TYPES:
            raise HeaderError(f"no header line type {kind!r}")
        self.kind, self.tags = kind, list(tags or [])

    @classmethod
    def header_line(cls, version: str) -> Entry:
        return cls("HD", [("VN", version)])

    @classmethod
    def ref_sequence(cls, name: str, length: int) -> Entry:
        return cls("SQ", [("SN", name), ("LN", str(length))])

    @classmethod
    def read_group(cls, name: str) -> Entry:
        return cls("RG", [("ID", name)])

    @classmethod
    def program(cls, name: str) -> Entry:
        return cls("PG", [("ID", name)])

    @classmethod
    def parse(cls, line: str) -> Entry:
        first, *rest = line.split("\t")
        if len(first) != 3 or first[0] != "@":
            raise HeaderError(f"no header line: {line!r}")
        for x in rest:
            if len(x) < 3 or x[2] != ":":
                raise HeaderError(f"no header tag: {x!r}")
        return cls(first[1:], [(x[:2], x[3:]) for x in rest])

    def get(self, name: str) -> str | None:
        return next((v for n, v in self.tags if n == name), None)

    def push(self, name: str, value: str) -> Entry:
        self.tags.append((name, value))
        return self

    def insert(self, name: str, value: str) -> None:
        """Replaces the first tag of that name, or appends."""
        for i, (n, _) in enumerate(self.tags):
            if n == name:
                self.tags[i] = (name, value)
                return
        self.push(name, value)

    def remove(self, name: str) -> bool:
        for i, (n, _) in enumerate(self.tags):
            if n == name:
                del self.tags[i]
                return True
        return False

    def __len__(self) -> int:
        return len(self.tags)

    def __iter__(self):
        return iter(self.tags)

    def __str__(self) -> str:
        return "\t".join([f"@{self.kind}", *(f"{n}:{v}" for n, v in self.tags)])


class Header:
    """Lines in order; comments are plain strings. Lines are added, never removed."""

    def __init__(self, text: str = ""):
        self.lines: list[Entry | str] = []
        self.names: list[str] = []
        self.lengths: list[int] = []
        self.ids: dict[str, int] = {}
        for line in text.split("\n"):
            if line := line.removesuffix("\r"):
                self.push_line(line)

    def push_entry(self, entry: Entry) -> Header:
        if entry.kind == "SQ":
            name, length = entry.get("SN"), entry.get("LN")
            if name is None or length is None or not (length.isascii() and length.isdigit()):
                raise HeaderError("a reference line needs SN and a whole LN")
            if not 0 < int(length) < 1 << 32:
                raise HeaderError("a reference's length has to be positive, under 2**32")
            if name in self.ids:
                raise HeaderError(f"reference {name} occurs twice")
            self.ids[name] = len(self.names)
            self.names.append(name)
            self.lengths.append(int(length))
        self.lines.append(entry)
        return self

    def push_comment(self, text: str) -> Header:
        self.lines.append(text)
        return self

    def push_line(self, line: str) -> Header:
        if line.startswith("@CO"):
            _, tab, text = line.partition("\t")
            if not tab:
                raise HeaderError(f"no comment line: {line!r}")
            return self.push_comment(text)
        return self.push_entry(Entry.parse(line))

    @property
    def n_references(self) -> int:
        return len(self.names)

    def reference_id(self, name: str) -> int | None:
        return self.ids.get(name)

    def reference_name(self, number: int) -> str | None:
        return self.names[number] if 0 <= number < len(self.names) else None

    def reference_len(self, number: int) -> int | None:
        return self.lengths[number] if 0 <= number < len(self.lengths) else None

    def text(self) -> str:
        return "".join(f"@CO\t{x}\n" if isinstance(x, str) else f"{x}\n" for x in self.lines)

    def is_sorted(self) -> bool:
        return any(isinstance(x, Entry) and x.kind == "HD" and x.get("SO") == "coordinate" for x in self.lines)

    def binary(self) -> bytes:
        text = self.text().encode()
        refs = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<I", k) for n, k in zip(self.names, self.lengths))
        return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.names)) + refs

    @classmethod
    def from_binary(cls, read, lenient: bool = False) -> Header:
        """read(n) gives the file's next bytes. References and text have to agree; a lenient reading
        takes references that the text lacks altogether from the binary part."""
        need = lambda n: got if len(got := read(n)) == n else _cut()
        if read(4) != b"BAM\1":
            raise HeaderError("not a binary alignment file")
        raw = need(struct.unpack("<i", need(4))[0])
        try:
            header = cls(raw.rstrip(b"\0").decode())
        except UnicodeDecodeError:
            raise HeaderError("a header has to be UTF-8") from None
        refs = []
        for _ in range(struct.unpack("<i", need(4))[0]):
            name = need(struct.unpack("<i", need(4))[0])[:-1].decode()
            refs.append((name, struct.unpack("<I", need(4))[0]))
        if lenient and not header.names:
            for name, length in refs:
                header.push_entry(Entry.ref_sequence(name, length))
        if refs != list(zip(header.names, header.lengths)):
            raise HeaderError("references of the header's text and binary part differ")
        return header

    def lines_df(self, spark: SparkSession) -> DataFrame:
        """line_no, type, tags (array of name and value), comment."""
        rows = [(i, "CO", None, x) if isinstance(x, str) else (i, x.kind, list(x.tags), None) for i, x in enumerate(self.lines)]
        return spark.createDataFrame(rows, "line_no int, type string, tags array<struct<name:string,value:string>>, comment string")

    def ref_sequences(self, spark: SparkSession) -> DataFrame:
        """ref_id, rname, rlen."""
        return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(zip(self.names, self.lengths))], "ref_id int, rname string, rlen bigint")


def _cut() -> bytes:
    raise HeaderError("the header is cut off")
