"""MathType equations (MTEF version 5) as LaTeX, after the public description of the format.

Never guesses: what isn't known leaves the equation unconverted with a warning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from tessella.functions.parsers import FUNCTIONS, SYMBOLS, split_commands

DEPTH, RECORDS, SIZE = 128, 100_000, 20 << 20
OLE_HEADER = 28

# Template selectors of the format.
FENCES = {0: (r"\langle ", r"\rangle "), 1: ("(", ")"), 2: (r"\{", r"\}"), 3: ("[", "]"), 4: ("|", "|"), 5: (r"\|", r"\|"), 6: (r"\lfloor ", r"\rfloor "), 7: (r"\lceil ", r"\rceil "), 8: ("[", "[")}
OPERATORS = {15: r"\int", 16: r"\sum", 17: r"\prod", 18: r"\coprod", 19: r"\bigcup", 20: r"\bigcap", 21: r"\int", 22: r"\sum"}
WRAPPERS = {12: "underline", 13: "overline", 24: "overbrace", 25: "overbrace", 31: "vec", 32: "widetilde", 33: "widehat", 34: "overarc", 35: "overline", 36: "cancel", 37: "boxed"}
EMBELLISHMENTS = {2: r"\dot{%s}", 3: r"\ddot{%s}", 4: r"\dddot{%s}", 5: "%s'", 6: "%s''", 8: r"\tilde{%s}", 9: r"\hat{%s}", 10: r"\not{%s}", 11: r"\vec{%s}", 17: r"\bar{%s}", 18: "%s'''"}


class MtefError(ValueError):
    """The equation can't be read."""


@dataclass
class Node:
    kind: str
    children: list = field(default_factory=list)
    text: str = ""
    code: int = 0
    variation: int = 0


class Reader:
    def __init__(self, data: bytes):
        if len(data) > SIZE:
            raise MtefError("too large")
        self.data, self.at, self.records = data, 0, 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise MtefError("cut short")
        self.at += 1
        return self.data[self.at - 1]

    def short(self) -> int:
        return self.byte() | self.byte() << 8

    def count(self) -> int:
        n = self.byte()
        return self.short() if n == 255 else n

    def text(self) -> str:
        end = self.data.find(0, self.at)
        if end < 0:
            raise MtefError("cut short")
        s, self.at = self.data[self.at : end], end + 1
        return s.decode("latin-1")

    def nudge(self, options: int) -> None:
        if options & 8 and (self.byte(), self.byte()) == (128, 128):
            self.short(), self.short()

    def list(self, depth: int) -> list[Node]:
        """Records up to the end mark."""
        out: list[Node] = []
        while (tag := self.byte()) != 0:
            node = self.record(tag, depth + 1)
            if node is not None:
                out.append(node)
        return out

    def record(self, tag: int, depth: int) -> Node | None:
        self.records += 1
        if depth > DEPTH or self.records > RECORDS:
            raise MtefError("nested too deeply")
        if tag >= 100:
            n = self.count()
            self.at += n
            return None
        reader = {1: self.line, 2: self.char, 3: self.template, 4: self.pile, 5: self.matrix}.get(tag)
        if reader:
            return reader(depth)
        if tag == 7:
            for _ in range(self.byte()):
                self.byte(), self.short()
        elif tag == 8:
            self.count(), self.byte()
        elif tag == 9:
            n = self.byte()
            if n == 101:
                self.short()
            elif n == 100:
                self.byte(), self.short()
            else:
                self.byte()
        elif tag == 15:
            self.count()
        elif tag == 16:
            options = self.byte()
            for _ in range(4 if options & 1 else 3):
                self.short()
            if options & 4:
                self.text()
        elif tag == 17:
            self.count(), self.text()
        elif tag == 18:
            self.preferences()
        elif tag == 19:
            self.text()
        elif tag not in (10, 11, 12, 13, 14):
            raise MtefError(f"unknown record {tag}")
        return None

    def preferences(self) -> None:
        """Sizes and spacings as half bytes, each list with its length, then the styles."""
        self.byte()
        for _ in range(2):
            left = self.byte()
            while left:
                packed = self.byte()
                left -= (packed >> 4 == 15) + (packed & 15 == 15 and left > 0)
        for _ in range(self.byte()):
            if self.byte():
                self.byte()

    def line(self, depth: int) -> Node:
        options = self.byte()
        self.nudge(options)
        if options & 4:
            self.short()
        if options & 2 and self.byte() == 7:
            self.record(7, depth)
        return Node("line", [] if options & 1 else self.list(depth))

    def char(self, depth: int) -> Node:
        options = self.byte()
        self.nudge(options)
        face = self.byte()
        code = 0 if options & 32 else self.short()
        if options & 4:
            self.byte()
        if options & 16:
            self.short()
        if not code or 0xE000 <= code <= 0xF8FF:
            raise MtefError(f"unknown character {code:#x} of typeface {face}")
        embellishments = []
        if options & 1:
            while (tag := self.byte()) != 0:
                if tag != 6:
                    raise MtefError("embellishment expected")
                inner = self.byte()
                self.nudge(inner)
                embellishments.append(self.byte())
        return Node("char", embellishments, chr(code))

    def template(self, depth: int) -> Node:
        options = self.byte()
        self.nudge(options)
        selector, variation = self.byte(), self.byte()
        if variation & 128:
            variation = variation & 127 | self.byte() << 8
        self.byte()
        return Node("template", self.list(depth), code=selector, variation=variation)

    def pile(self, depth: int) -> Node:
        options = self.byte()
        self.nudge(options)
        self.byte(), self.byte()
        if options & 2 and self.byte() == 7:
            self.record(7, depth)
        return Node("pile", self.list(depth))

    def matrix(self, depth: int) -> Node:
        options = self.byte()
        self.nudge(options)
        for _ in range(3):
            self.byte()
        rows, columns = self.byte(), self.byte()
        if rows * columns > 10_000:
            raise MtefError("matrix too large")
        self.at += (2 * (rows + 1) + 7) // 8 + (2 * (columns + 1) + 7) // 8
        return Node("matrix", self.list(depth), code=rows, variation=columns)


def parsed(data: bytes) -> list[Node]:
    r = Reader(data)
    if r.byte() != 5:
        raise MtefError("not version 5")
    for _ in range(4):
        r.byte()
    r.text()
    r.byte()
    nodes = r.list(0)
    if any(data[r.at :]):
        raise MtefError("bytes left over")
    return nodes


def sequence(nodes: list[Node]) -> str:
    out, letters = "", ""

    def flush() -> None:
        nonlocal out, letters
        out += f"\\{letters} " if letters in FUNCTIONS else letters
        letters = ""

    for n in nodes:
        if n.kind == "char" and not n.children and n.text.isascii() and n.text.isalpha():
            letters += n.text
        else:
            flush()
            out += rendered(n)
    flush()
    return out


def rendered(n: Node) -> str:
    if n.kind == "line":
        return sequence(n.children)
    if n.kind == "pile":
        return r"\begin{matrix}" + r" \\ ".join(rendered(x).strip() for x in n.children) + r"\end{matrix}"
    if n.kind == "matrix":
        cells = [rendered(x).strip() for x in n.children if x.kind == "line"]
        if len(cells) != n.code * n.variation:
            raise MtefError("matrix of another size")
        return r"\begin{matrix}" + r" \\ ".join(" & ".join(cells[k : k + n.variation]) for k in range(0, len(cells), n.variation)) + r"\end{matrix}"
    if n.kind == "char":
        s = SYMBOLS.get(n.text, n.text)
        for e in n.children:
            if e not in EMBELLISHMENTS:
                raise MtefError(f"unknown embellishment {e}")
            s = EMBELLISHMENTS[e] % s.strip()
        return s
    slots = [sequence(x.children).strip() for x in n.children if x.kind in ("line", "pile")]
    slot = lambda k: slots[k] if k < len(slots) else ""
    if n.code in FENCES:
        left, right = FENCES[n.code]
        return rf"\left{left if n.variation & 1 or not n.variation else '.'}{slot(0)}\right{right if n.variation & 2 or not n.variation else '.'}"
    if n.code == 10:
        return rf"\sqrt[{slot(1)}]{{{slot(0)}}}" if n.variation == 1 and slot(1) else rf"\sqrt{{{slot(0)}}}"
    if n.code in (11, 14):
        return rf"\frac{{{slot(0)}}}{{{slot(1)}}}" if n.code == 11 else rf"\xrightarrow[{slot(1)}]{{{slot(0)}}}"
    if n.code in OPERATORS:
        low, high = slot(1), slot(2)
        return OPERATORS[n.code] + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + " " + slot(0)
    if n.code == 23:
        return slot(0) + (f"_{{{slot(1)}}}" if slot(1) else "") + (f"^{{{slot(2)}}}" if slot(2) else "")
    if n.code in (27, 28, 29):
        sub, sup = {27: (slot(0), ""), 28: ("", slot(1) or slot(0)), 29: (slot(0), slot(1))}[n.code]
        return (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "")
    if n.code in WRAPPERS:
        return rf"\{WRAPPERS[n.code]}{{{slot(0)}}}"
    raise MtefError(f"unknown template {n.code}")


def latex(data: bytes) -> tuple[str, str]:
    """(LaTeX, warning) of an equation, with or without the header of its stream; ('', warning) when it can't be read."""
    warning = ""
    for start in (0, OLE_HEADER):
        try:
            return " ".join(split_commands(sequence(parsed(data[start:]))).split()), ""
        except (MtefError, IndexError) as e:
            warning = str(e)
    return "", warning
