"""Source text to token strings ("frames") that the chart parser can judge one by one.

Every bracket group, statement line (Python) or statement, item and arm (Rust)
becomes a string of its own, in which inner groups are single tokens, so that
strings are short and the same ones recur over and over in a corpus. A frame is
``language:rule tokens``; brackets that don't match give a frame of brackets
(a text or comment left open counts as one), text that no token fits gives the
token ``?`` and the mark of a merge conflict the token ``mark``.

``frames`` merges equal clauses of long lists, so that few distinct strings
come out; ``whole_frames`` keeps every token with its line.
"""

from __future__ import annotations

import re

# fixed values: reserved words of both languages
PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
RS_WORDS = frozenset("as async await box break const continue crate default dyn else enum extern false fn for if impl in let loop match mod move mut pub raw ref return self Self static struct super trait true type union unsafe use where while".split())
RS_SOFT = frozenset("box default raw union".split())  # words only in some places
CLOSERS = {")": "(", "]": "[", "}": "{"}
CLASSES = {"(": "P", "[": "Q", "{": "B"}
BRACKETS = {"(": "o1", ")": "c1", "[": "o2", "]": "c2", "{": "o3", "}": "c3", "open": "o4"}

_MARK = r"(?m:^)(?:<{7}|>{7}|\|{7}|={7})(?![^ \t\r\n])[^\r\n]*"  # fixed value: lines by which version control marks conflicts
_PY = re.compile(
    r"""(?P<space>[ \t\f]+|\\\r?\n)|(?P<comment>\#[^\r\n]*)|(?P<line>\r\n|\n|\r)
    |(?P<string>(?i:[bru]|br|rb|f|fr|rf)?(?:\"\"\"|'''|"|'))|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))
    |(?P<name>[^\W\d]\w*)|""" rf"(?P<mark>{_MARK})" r"""|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=])""",
    re.X,
)
_RS = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*)|(?P<block>/\*)|(?P<raw>(?:b|c)?r(?P<hash>\#*)")|(?P<string>(?:b|c)?"(?:[^"\\]|\\.)*")
    |(?P<char>b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))')|(?P<life>'[^\W\d]\w*)
    |(?P<number>0[xX][0-9a-fA-F_]+\w*|0[bo][0-7_]+\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf]\w*)?|\d[\d_]*\.(?![.\w]))
    |(?P<name>(?:r\#)?[^\W\d]\w*)|""" rf"(?P<mark>{_MARK})" r"""|(?P<op>\.\.=|\.\.\.|::|->|=>|\.\.|==|!=|<=|\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|[-+*/%^&|!~<>()\[\]{},:.;=@?\#$])""",
    re.X | re.S,
)


class Out(list):
    """(frame, first line, lines of its tokens): without ``whole`` shortened, and without the lines of tokens."""

    def __init__(self, whole: bool = False):
        self.whole = whole

    def put(self, rule: str, words: list[str], lines: list[int], line: int) -> None:
        if self.whole:
            self.append((f"{rule} {' '.join(words)}", line, lines or [line]))
        else:
            self.append((f"{rule} {' '.join(_shorten(words))}", line, None))

    def wrong(self, line: int) -> None:
        self.append(("br:Ctx ?", line, [line]))


class Tree:
    """Tokens of a text with their lines; a group is (opening bracket, line, its tokens)."""

    def __init__(self):
        self.root: list[tuple] = []
        self.stack: list[tuple[str, int, list[tuple]]] = []
        self.loose: list[tuple[str, int]] = []  # brackets that match nothing
        self.broken: list[int] = []  # lines with text that is no token

    @property
    def now(self) -> list[tuple]:
        return self.stack[-1][2] if self.stack else self.root

    def add(self, token: str, text: str, line: int) -> None:
        self.now.append((token, text, line))

    def bracket(self, text: str, line: int) -> None:
        if text in CLASSES:
            self.stack.append((text, line, []))
        elif self.stack and self.stack[-1][0] == CLOSERS[text]:
            opened, begin, tokens = self.stack.pop()
            self.now.append((CLASSES[opened], tokens, begin))
        else:
            self.loose.append((text, line))

    def end(self) -> None:
        unclosed = [(b, line) for b, line, _ in self.stack]
        self.loose = sorted([*self.loose, *unclosed], key=lambda x: x[1])
        self.stack = self.stack[:0]

    def frames(self, out: Out) -> None:
        for line in self.broken:
            out.wrong(line)
        if self.loose:
            out.put("br:Ctx", [BRACKETS[b] for b, _ in self.loose], [line for _, line in self.loose], self.loose[0][1])


def _shorten(tokens: list[str]) -> list[str]:
    """Runs of equal members of a comma list say no more than two of them."""
    if tokens.count(",") < 4:
        return tokens
    members: list[list[str]] = [[]]
    for t in tokens:
        if t == ",":
            members.append([])
        else:
            members[-1].append(t)
    kept = [m for i, m in enumerate(members) if not (2 <= i < len(members) - 2 and m == members[i - 1] == members[i - 2])]
    out: list[str] = []
    for i, m in enumerate(kept):
        out += [","] * (i > 0) + m
    return out


# ---- Python


_PY_STRING = re.compile(r"(?i:[bru]|br|rb|f|fr|rf)?(?:\"\"\"|'''|\"|')")
_PY_WORD = re.compile(r"\w+")
_PY_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|N\{(?P<name>[^{}]*)\}|(?P<short>[xuUN])|.)", re.S)
_PY_CONVERSION = re.compile(r"![rsa]\s*(?=[:}])")


def _py_escapes(body: str, is_bytes: bool) -> bool:
    """Whether the text of a string literal holds only escapes and characters that Python decodes."""
    if is_bytes:
        return body.isascii() and not re.search(r"\\x(?![0-9a-fA-F]{2})", re.sub(r"\\[^x]", "", body, flags=re.S))
    if "\\" in body:
        for m in _PY_ESCAPE.finditer(body):
            if m["short"]:
                return False
            if m["name"] is not None:
                try:
                    m[0].encode("ascii").decode("unicode_escape")
                except UnicodeError:
                    return False
    return True


def _py_string(text: str, start: int, opened: str, fields: list[tuple[int, int]]) -> int:
    """Where the string that opens at ``start`` ends; -1 if it doesn't.

    The expressions in its f-string fields are added to ``fields``; a part of
    an f-string that can't stand there is added as (place, -1).
    """
    prefix = opened.rstrip("\"'").lower()
    quote = opened[len(prefix) :]
    at, n = start + len(opened), len(text)
    formatted, raw = "f" in prefix, "r" in prefix
    part = at  # begin of the literal text since the last field

    def check(end: int) -> None:
        if not _py_escapes(text[part:end], "b" in prefix) if not raw else "b" in prefix and not text[part:end].isascii():
            fields.append((part, -1))

    while at < n:
        c = text[at]
        if c == "\\":
            if formatted and text[at + 1 : at + 2] in ("{", "}"):
                at += 1
            elif formatted and not raw and text.startswith("N{", at + 1):
                at = text.find("}", at) + 1 or at + 3
            else:
                at += 3 if text.startswith("\r\n", at + 1) else 2
        elif text.startswith(quote, at):
            check(at)
            return at + len(quote)
        elif len(quote) == 1 and c in "\r\n":
            return -1
        elif formatted and c in "{}":
            if text.startswith(c * 2, at):
                at += 2
                continue
            if c == "}":
                fields.append((at, -1))
                at += 1
                continue
            check(at)
            at = part = _py_field(text, at + 1, quote, raw, fields)
            if at < 0:
                return -1
        else:
            at += 1
    return -1


def _py_field(text: str, at: int, quote: str, raw: bool, fields: list[tuple[int, int]]) -> int:
    """Where the field whose expression begins at ``at`` ends; -1 if it doesn't."""
    depth, begin = 0, at

    def expression(end: int) -> None:
        shown = re.search(r"(?<![=!<>:])=\s*$", text[begin:end])  # f"{x=}"
        fields.append((begin, begin + shown.start() if shown else end))

    while at < len(text):
        c = text[at]
        opened = _PY_STRING.match(text, at)
        if opened:
            at = _py_string(text, at, opened[0], [])
            if at < 0:
                return -1
            continue
        if c == "_" or c.isalnum():
            at = _PY_WORD.match(text, at).end()
            continue
        if c == "#":
            while at < len(text) and text[at] not in "\r\n":
                at += 1
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if depth == 0:
                if c == "}":
                    expression(at)
                return at + 1 if c == "}" else -1
            depth -= 1
        elif depth == 0 and c == "!" and not text.startswith("!=", at):
            expression(at)
            m = _PY_CONVERSION.match(text, at)
            if not m:
                return -1
            at = m.end()
            return at + 1 if text[at] == "}" else _py_format(text, at + 1, quote, raw, fields)
        elif depth == 0 and c == ":":
            expression(at)
            return _py_format(text, at + 1, quote, raw, fields)
        at += 1
    return -1


def _py_format(text: str, at: int, quote: str, raw: bool, fields: list[tuple[int, int]]) -> int:
    """Where the field whose format, in which fields may nest, begins at ``at`` ends; -1 if it doesn't."""
    part = at
    while at < len(text) and text[at] != "}":
        if text[at] == "\\" and not raw and text.startswith("N{", at + 1):
            at = text.find("}", at) + 1 or at + 3
        elif text[at] == "{":
            if not raw and not _py_escapes(text[part:at], False):
                fields.append((part, -1))
            at = part = _py_field(text, at + 1, quote, raw, fields)
            if at < 0:
                return -1
        elif text[at] in "\r\n" and len(quote) == 1 or text.startswith(quote, at):
            return -1
        else:
            at += 1
    if not raw and not _py_escapes(text[part:at], False):
        fields.append((part, -1))
    return at + 1 if at < len(text) else -1


def python_frames(text: str, whole: bool = False) -> Out:
    inner = Out(whole)
    tree, lines = _py_tokens(text, 1, inner)
    out = Out(whole)
    tree.frames(out)
    _py_blocks(lines, out)
    out += inner
    return out


def _py_fields(text: str, start: int, line: int, fields: list[tuple[int, int]], out: Out) -> None:
    """Frames of the expressions in the fields of the string that begins at ``start``."""
    for begin, end in fields:
        at = line + text.count("\n", start, begin)
        if end < 0:
            out.wrong(at)
            continue
        tree, lines = _py_tokens("(" + text[begin:end] + "\n)", at, out)
        tree.frames(out)
        if len(lines) == 1 and len(lines[0][2]) == 1:
            _py_emit(lines[0][2][0][1], "CtxField", at, out, False)
        else:
            out.wrong(at)


def _py_tokens(text: str, line: int, inner: Out) -> tuple[Tree, list[tuple]]:
    """Brackets and loose ends, and statement lines; the frames inside f-strings go to ``inner``."""
    tree, at, n = Tree(), 0, len(text)
    lines: list[tuple[int, int, list[tuple], int]] = []  # (indentation, line, tokens, indentation with tabs as one column)
    indent, narrow, fresh, begin = 0, 0, True, line
    if text.startswith("﻿"):
        at = 1
    while at < n:
        m = _PY.match(text, at)
        if not m:
            tree.broken.append(line)
            tree.add("?", text[at], line)
            at += 1
            fresh = False
            continue
        kind, piece = m.lastgroup, m[0]
        at = m.end()
        if text[at : at + 1] == " " and kind != "line" and (kind != "space" or not fresh):
            at += 1  # most tokens are followed by one blank
        if kind == "line":
            if not tree.stack:
                if tree.root:
                    lines.append((indent, begin, tree.root, narrow))
                    tree.root = []
                fresh, indent, narrow = True, 0, 0
            line += 1
        elif kind == "space":
            if fresh and not tree.root and "\\" not in piece:
                piece = piece.rpartition("\f")[2]
                indent, narrow = len(piece.expandtabs(8)), len(piece)
            line += piece.count("\n")
        elif kind != "comment":
            if not tree.root and not tree.stack:
                begin = line
            fresh = False
            if kind == "mark":
                tree.add("mark", piece, line)
            elif kind == "string":
                fields: list[tuple[int, int]] = []
                at = m.end()
                end = _py_string(text, m.start(), piece, fields)
                token = "y" if "b" in piece.lower() else "s"
                if end < 0:
                    if len(piece.rstrip("\"'")) + 3 == len(piece):
                        tree.loose.append(("open", line))
                    else:
                        tree.broken.append(line)
                    tree.add("?", piece, line)
                    end = n if len(piece.rstrip("\"'")) + 3 == len(piece) else next((i for i in range(at, n) if text[i] in "\r\n"), n)
                else:
                    if not (tree.now and tree.now[-1][0] == token):
                        tree.add(token, "", line)
                    _py_fields(text, m.start(), line, fields, inner)
                line += text.count("\n", m.start(), end)
                at = end
            elif kind == "number":
                after = text[m.end() : m.end() + 1]
                bad = after.isalnum() or after == "_" or re.fullmatch(r"0[\d_]*[1-9][\d_]*", piece)
                if bad:
                    tree.broken.append(line)
                tree.add("n", piece, line)
            elif kind == "name":
                tree.add(piece if piece in PY_WORDS else "N", piece, line)
            elif piece in BRACKETS:
                tree.bracket(piece, line)
            else:
                tree.add(piece, piece, line)
    tree.end()
    if tree.root:
        lines.append((indent, begin, tree.root, narrow))
    return tree, lines


_HEADS = frozenset("if elif else for while try except finally with def class".split())
_FOLLOW = ("elif", "else", "except", "finally", "case")


def _py_blocks(lines: list[tuple[int, int, list[tuple], int]], out: Out) -> None:
    stack: list[tuple[int, list[tuple[str, int]], str, int]] = [(0, [], "Block", 0)]
    waits = ""  # the kind of the line before, if a block must follow

    def close(block: tuple[int, list[tuple[str, int]], str, int]) -> None:
        _, entries, rule, _ = block
        if rule == "Cases":
            words = [e for e, _ in entries]
            out.put("py:CtxCases", words if out.whole else list(dict.fromkeys(words)), [ln for _, ln in entries], entries[0][1])
            return
        group: list[tuple[str, int]] = []
        for e, ln in entries:
            if group and not e.startswith(_FOLLOW) and not group[-1][0].startswith("decorator"):
                out.put("py:CtxBlock", [x for x, _ in group], [ln for _, ln in group], group[0][1])
                group = []
            if out.whole or not (group and group[-1][0] == e and e.startswith(("elif", "except", "decorator"))):
                group.append((e, ln))
        if group:
            out.put("py:CtxBlock", [x for x, _ in group], [ln for _, ln in group], group[0][1])

    marks = [x for x in lines if len(x[2]) == 1 and x[2][0][0] == "mark"]  # they belong to no block
    for _, ln, tokens, _ in marks:
        _py_emit(tokens, "CtxLine", ln, out, False)
    lines = [x for x in lines if x not in marks] if marks else lines
    for k, (indent, ln, tokens, narrow) in enumerate(lines):
        words = [t[0] for t in tokens]
        if indent > stack[-1][0]:
            if narrow <= stack[-1][3]:
                out.wrong(ln)  # deeper or not by the width of a tab
            entries = stack[-1][1]
            if waits:
                entries[-1] = (waits + "{}", entries[-1][1])
                stack.append((indent, [], "Cases" if waits == "match" else "Block", narrow))
            else:
                out.wrong(ln)
                stack.append((indent, [], "Block", narrow))
        else:
            while indent < stack[-1][0]:
                close(stack.pop())
            if indent == stack[-1][0] and narrow != stack[-1][3]:
                out.wrong(ln)
            if indent != stack[-1][0]:
                out.wrong(ln)
                stack.append((indent, [], "Block", narrow))
        head = next((w for w in words if w != "async"), "")
        deeper = k + 1 < len(lines) and lines[k + 1][0] > indent
        waits = ""
        if words[-1] == ":" and tokens[0][1] == "match" and len(words) > 2 and deeper and lines[k + 1][2][0][1] == "case":
            kind = waits = "match"
            tokens = [("MATCH", "", ln), *tokens[1:]]
        elif stack[-1][2] == "Cases" and tokens[0][1] == "case" and ":" in words:
            kind = "case"
            tokens = [("CASE", "", ln), *tokens[1:]]
        elif head in _HEADS:
            kind = head
        elif words[0] == "@":
            kind = "decorator"
        else:
            kind = "one"
            if tokens[0][1] == "type" and len(words) > 3 and words[1] == "N" and words[2] in ("=", "Q"):
                tokens = [("TYPE", "", ln), *tokens[1:]]
        if kind not in ("one", "decorator"):
            if words[-1] == ":":
                waits = kind
                entry = kind + ":"
            else:
                entry = kind + "1"
        else:
            entry = kind
        stack[-1][1].append((entry, ln))
        _py_emit(tokens, "CtxLine", ln, out, False)
    while stack:
        block = stack.pop()
        if block[1]:
            close(block)


_OPERANDS = frozenset("N P Q B s y n True False None ...".split())


_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
# contexts of brackets that are assigned to, deleted, or the one target of an annotation or augmented assignment
_TARGETS = {"assign": {"P": "CtxTuple", "Q": "CtxTargets"}, "del": {"P": "CtxDel", "Q": "CtxDel"}, "single": {"P": "CtxSingle", "Q": "CtxList"}}


def _py_targets(words: list[str], rule: str) -> list[str]:
    """For each token of a frame the kind of target (a key of ``_TARGETS``) it belongs to, or nothing."""
    inside = {"CtxTuple": "assign", "CtxTargets": "assign", "CtxDel": "del", "CtxSingle": "single"}.get(rule)
    if inside:
        return [inside] * len(words)
    out, n = [""] * len(words), len(words)
    if rule == "CtxLine":
        start = 0
        header = words[0] in _HEADS or words[0] == "async" or words[0] in ("MATCH", "CASE", "@", "TYPE")
        if header:  # statements after the colon
            lambdas = 0
            for start, w in enumerate(words):
                lambdas += w == "lambda"
                if w == ":":
                    lambdas -= 1
                    if lambdas < 0:
                        break
            start += 1
        while start < n:
            end = next((i for i in range(start, n) if words[i] == ";"), n)
            part = words[start:end]
            until = part.index("lambda") if "lambda" in part else len(part)
            ops = [i for i in range(until) if part[i] in ("=", ":") or part[i] in _AUGMENTED]
            if part[:1] == ["del"]:
                out[start + 1 : end] = ["del"] * max(end - start - 1, 0)
            elif ops and part[ops[0]] != "=":
                out[start : start + ops[0]] = ["single"] * ops[0]
            elif ops:
                out[start : start + ops[-1]] = ["assign"] * ops[-1]
            start = end + 1
    kind = ""
    for i, w in enumerate(words):
        if w == "for" or w == "as" and (rule == "CtxWith" or "with" in words[:2]):
            kind = w
        elif kind == "for" and w == "in" or kind == "as" and w in (",", ":"):
            kind = ""
        elif kind:
            out[i] = "assign"
    return out


def _py_emit(tokens: list[tuple], rule: str, line: int, out: Out, pattern: bool) -> None:
    words: list[str] = []
    start = tokens[0][0] if tokens else ""
    start = tokens[1][0] if start == "async" and len(tokens) > 1 else start
    in_case = start == "CASE"
    all_words = [t[0] for t in tokens]
    targets = _py_targets(all_words, rule) if not pattern else []
    for i, (word, inner, ln) in enumerate(tokens):
        before = words[-1] if words else ""
        if in_case and word in ("if", ":"):
            in_case = False
        if word in ("P", "Q", "B"):
            pat = pattern or in_case
            if pat:
                ctx = {"P": "CtxPatArgs" if before == "N" else "CtxPatSeq", "Q": "CtxPatList", "B": "CtxPatMap"}[word]
            elif word != "B" and targets[i] and before not in _OPERANDS and all_words[i + 1 : i + 2] not in (["."], ["P"], ["Q"]):
                ctx = _TARGETS[targets[i]][word]
            elif word == "P":
                if rule == "CtxLine" and start == "def" and "P" not in words:
                    ctx = "CtxParams"
                elif before == "import":
                    ctx = "CtxImports"
                elif rule == "CtxLine" and before == "with" and all_words[i + 1 : i + 2] == [":"]:
                    ctx = "CtxWith"
                elif rule == "CtxLine" and start == "class" and "P" not in words and ":" not in words:
                    ctx = "CtxBases"
                else:
                    ctx = "CtxArgs" if before in _OPERANDS else "CtxParen"
            elif word == "Q":
                named = rule == "CtxLine" and start in ("def", "class", "TYPE") and len(words) in (2, 3) and before == "N" and words[-2] in ("def", "class", "TYPE")
                ctx = "CtxTypes" if named else "CtxSub" if before in _OPERANDS else "CtxList"
            else:
                ctx = "CtxBrace"
            _py_emit(inner, ctx, ln, out, pat)
        words.append(word)
    if words or rule not in ("CtxArgs", "CtxParen", "CtxList", "CtxBrace", "CtxParams", "CtxBases", "CtxTuple", "CtxTargets", "CtxDel", "CtxPatSeq", "CtxPatList", "CtxPatArgs", "CtxPatMap"):
        out.put(f"py:{rule}", words, [t[2] for t in tokens], line)


# ---- Rust


def rust_frames(text: str, whole: bool = False) -> Out:
    tree, at, line, n = Tree(), 0, 1, len(text)
    if text.startswith("﻿"):
        at = 1
    if text.startswith("#!", at) and not re.match(r"#!\s*\[", text[at:]):
        at = text.find("\n") if "\n" in text else n
    while at < n:
        m = _RS.match(text, at)
        if not m:
            if text[at] == '"':
                tree.loose.append(("open", line))
            else:
                tree.broken.append(line)
            tree.add("?", text[at], line)
            end = n if text[at] == '"' else at + 1
            line += text.count("\n", at, end)
            at = end
            continue
        kind, piece, end = m.lastgroup, m[0], m.end()
        if kind == "hash":
            kind = "raw"
        if kind == "block":
            depth, end = 1, at + 2
            while depth and end < n:
                nxt = re.compile(r"/\*|\*/").search(text, end)
                if not nxt:
                    end = n
                    break
                depth += 1 if nxt[0] == "/*" else -1
                end = nxt.end()
            if depth:
                tree.loose.append(("open", line))
                end = n
        elif kind == "raw":
            close = '"' + m["hash"]
            end = text.find(close, m.end())
            if end < 0:
                tree.loose.append(("open", line))
                end = n
            else:
                end += len(close)
            tree.add("s", "", line)
        elif kind == "string":
            tree.add("s", "", line)
        elif kind == "mark":
            tree.add("mark", piece, line)
        elif kind == "char":
            tree.add("c", "", line)
        elif kind == "life":
            tree.add("t", piece, line)
        elif kind == "number":
            if end < n and (text[end].isalnum() or text[end] == "_"):
                tree.broken.append(line)
            tree.add("n", piece, line)
        elif kind == "name":
            tree.add(piece if piece in RS_WORDS and piece not in RS_SOFT else "_" if piece == "_" else "N", piece, line)
        elif kind == "op":
            if piece in BRACKETS:
                tree.bracket(piece, line)
            elif piece == "#" or piece == "$":
                tree.add(piece, piece, line)
            else:
                tree.add(piece, piece, line)
        line += text.count("\n", at, end)
        at = end
    tree.end()
    out = Out(whole)
    tree.frames(out)
    _rs_items(tree.root, out)
    return out


def _plain(tokens: list[tuple]) -> list[tuple]:
    """Without attributes."""
    out, i = [], 0
    while i < len(tokens):
        if tokens[i][0] == "#":
            j = i + 1 + (i + 1 < len(tokens) and tokens[i + 1][0] == "!")
            if j < len(tokens) and tokens[j][0] == "Q":
                i = j + 1
                continue
        out.append(tokens[i])
        i += 1
    return out


_ENDED = frozenset(("use", "static", "type"))  # items that end with ;
_ITEM = frozenset("fn struct enum trait impl mod extern pub use static type".split())


def _head(words: list[str], texts: list) -> str:
    """The word that says what an item is; empty if it is none."""
    at = 0
    while at < len(words):
        w = words[at]
        if w == "pub":
            at += 2 if at + 1 < len(words) and words[at + 1] == "P" else 1
        elif w in ("async", "unsafe") or w == "const" and at + 1 < len(words) and words[at + 1] in ("fn", "unsafe", "extern", "async"):
            at += 1
        elif w == "N" and texts[at] in ("default", "union") and at + 1 < len(words) and words[at + 1] in ("N", "fn", "impl", "unsafe"):
            if texts[at] == "union" and words[at + 1] == "N":
                return "union"
            at += 1
        elif w == "extern" and at + 1 < len(words) and words[at + 1] == "crate":
            return "use"
        elif w == "extern" and ("fn" in words[at : at + 3]):
            at = words.index("fn", at)
        else:
            break
    if at >= len(words):
        return ""
    w = words[at]
    if w == "const":
        return "static"
    if w in ("fn", "struct", "enum", "trait", "impl", "mod", "extern", "use", "static", "type"):
        return w
    if w == "N" and texts[at] == "macro_rules":
        return "macro"
    return ""


def _rs_items(tokens: list[tuple], out: Out) -> None:
    part: list[tuple] = []
    tokens = _plain(tokens)
    for i, t in enumerate(tokens):
        part.append(t)
        words = [x[0] for x in part]
        if t[0] == "mark" or i + 1 < len(tokens) and tokens[i + 1][0] == "mark":
            _rs_emit(part, "CtxMark" if t[0] == "mark" else "CtxItem", out)
            part = []
        elif t[0] == ";" or t[0] == "B" and _head(words, [x[1] for x in part]) not in _ENDED:
            if t[0] == "B" and i + 1 < len(tokens) and tokens[i + 1][0] == ";" and "!" in words[:4]:
                continue
            _rs_emit(part, "CtxItem", out)
            part = []
    if part:
        _rs_emit(part, "CtxItem", out)


_GOES_ON = frozenset(("else", ".", "?", "=", "=>", ",", "as", "..", "in", "B", "==", "&&"))
_BLOCKY = frozenset("if match loop while for unsafe B t".split())


def _rs_stmts(tokens: list[tuple], out: Out) -> None:
    tokens, part = _plain(tokens), []
    for i, t in enumerate(tokens):
        part.append(t)
        words = [x[0] for x in part]
        if t[0] == "mark" or i + 1 < len(tokens) and tokens[i + 1][0] == "mark":
            _rs_emit(part, "CtxMark" if t[0] == "mark" else "CtxTail", out)
            part = []
        elif t[0] == ";":
            _rs_emit(part, "CtxStmt", out)
            part = []
        elif t[0] == "B":
            nxt = tokens[i + 1][0] if i + 1 < len(tokens) else ""
            head = _head(words, [x[1] for x in part])
            macro = len(words) > 1 and words[-2] == "!" and all(w in ("N", "::", "!", "B", "crate", "self", "super") for w in words) or head == "macro"
            item = head and head not in _ENDED
            blocky = words[0] in _BLOCKY and (words[0] != "t" or words[1:2] == [":"]) or words[0] in ("const", "async") and not head
            alone = words[0] == "B" or words[:2] in (["unsafe", "B"], ["const", "B"], ["async", "B"])
            if macro and nxt not in (".", "?", ";") or item and not macro:
                _rs_emit(part, "CtxLoose" if not macro or head == "macro" else "CtxTail", out)
                part = []
            elif blocky and (nxt not in _GOES_ON or alone and nxt == "B"):
                _rs_emit(part, "CtxLoose", out)
                part = []
    if part:
        _rs_emit(part, "CtxTail", out)


def _rs_arms(tokens: list[tuple], out: Out) -> None:
    tokens, part, body, bars, skip = _plain(tokens), [], False, False, 0
    for i, t in enumerate(tokens):
        w = t[0]
        before = part[-1][0] if part else ""
        nxt = tokens[i + 1][0] if i + 1 < len(tokens) else ""
        if body and w == "|":
            if bars:
                bars = False
            elif before in ("=>", "=", "move", ",", "return"):
                bars = True
        if w == "," and body and not bars:
            _rs_emit(part, "CtxArm", out)
            part, body = [], False
            continue
        part.append(t)
        if w == "=>":
            body, begin = True, len(part)
        elif body and w == "B" and nxt not in _GOES_ON | {",", "+", "-", "*", "/", "|", "&", "<", ">", "!="}:
            if part[begin][0] in _BLOCKY or len(part) == begin + 1:
                _rs_emit(part, "CtxArm", out)
                part, body = [], False
    if part:
        _rs_emit(part, "CtxArm", out)


_PATH_END = frozenset(("N", "Self", ">"))


def _rs_emit(tokens: list[tuple], rule: str, out: Out, ctx: str = "") -> None:
    tokens = _plain(tokens)
    words: list[str] = []
    head = _head([t[0] for t in tokens], [t[1] for t in tokens]) if rule in ("CtxItem", "CtxStmt", "CtxLoose", "CtxTail") else ""
    pending = ""
    line = tokens[0][2] if tokens else 0
    for i, (word, inner, ln) in enumerate(tokens):
        before = words[-1] if words else ""
        nxt = tokens[i + 1][0] if i + 1 < len(tokens) else ""
        free = before == "!" and len(words) > 1 and words[-2] in ("N", "crate", "self", "super") or before == "N" and words[-2:-1] == ["!"]
        if word == "match":
            pending = "arms"
        elif word in ("if", "while", "for", "loop", "->", "unsafe", "else") or word == "async":
            pending = pending if word == "for" and rule == "CtxItem" else "block"
        elif word in (";", ",") or word == "=" and pending == "block" and "->" in words and "fn" not in words[:4]:
            pending = ""
        elif word == "P" and not free and before != "pub":
            if head == "fn" and "P" not in [w for j, w in enumerate(words) if words[j - 1 : j] != ["pub"]] and rule != "CtxTail":
                _rs_list(inner, "CtxParams", out)
            elif before == "fn":
                _rs_list(inner, "CtxFnTypes", out)
            elif before == "N" and tokens[i - 1][1] in ("Fn", "FnMut", "FnOnce"):
                _rs_list(inner, "CtxTypes", out)
            elif rule == "CtxVariants" or head == "struct":
                _rs_list(inner, "CtxTypes", out)
            else:
                _rs_list(inner, "CtxArgs", out)
        elif word == "Q" and not free:
            _rs_list(inner, "CtxArray", out)
        elif word == "B" and not free:
            if rule in ("CtxTree",) or head == "use":
                _rs_list(inner, "CtxTree", out)
            elif rule == "CtxVariants" or head in ("struct", "union"):
                _rs_list(inner, "CtxFields", out)
            elif head == "enum":
                _rs_list(inner, "CtxVariants", out)
            elif head in ("impl", "trait", "mod", "extern"):
                _rs_items(inner, out)
            elif head == "fn":
                _rs_stmts(inner, out)
            elif before in _PATH_END and (not pending or nxt in ("=", "in") or nxt == "B" and False):
                _rs_list(inner, "CtxInit", out)
            elif pending == "arms":
                _rs_arms(inner, out)
                pending = ""
            else:
                _rs_stmts(inner, out)
                pending = ""
        words.append(word)
    out.put(f"rs:{rule}", words, [t[2] for t in tokens], line)


def _rs_list(tokens: list[tuple], rule: str, out: Out) -> None:
    if tokens:
        _rs_emit(tokens, rule, out)


def _all(path: str, text: str, whole: bool) -> Out:
    ext = path.rpartition(".")[2]
    return python_frames(text, whole) if ext in ("py", "pyi", "pyx") else rust_frames(text, whole) if ext == "rs" else Out()


def frames(path: str, text: str) -> list[tuple[str, int]]:
    """(frame, line) of a text by the extension of its path; none for other extensions and empty texts."""
    return [(f, line) for f, line, _ in _all(path, text, False)]


def whole_frames(path: str, text: str) -> list[tuple[str, list[int]]]:
    """(frame, lines of its tokens), nothing merged."""
    return [(f, lines) for f, _, lines in _all(path, text, True)]
