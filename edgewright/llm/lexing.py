"""Texts to the token strings of their language's grammar, one character per token."""

from __future__ import annotations

import re
from functools import lru_cache

from edgewright.llm.grammar import LINE, MERGE, NONE, Grammar
from edgewright.llm.languages import grammar

_MARK = r"^(?:<{7}|>{7}|\|{7}|={7})(?![<>|=])[^\n]*"
_STR = r'"(?:[^"\\\n]|\\(?s:.))*"'
_CHR = r"'(?:[^'\\\n]|\\(?s:.))*'"
_SLASH = r"//[^\n]*|/\*(?s:.*?)\*/|/\*"
_NAME = r"[^\W\d]\w*"
_NUM = r"\.?\d(?:\w|\.(?=\d)|(?<=[eEpP])[+-](?=\d))*\.?(?![\w.])|\.?\d(?:\w|\.(?=\d)|(?<=[eE])[+-](?=\d))*"
_OPS = r">>>=|===|!==|\*\*=|\.\.\.|\.\.=|<<=|>>=|&&=|\|\|=|\?\?=|&\^=|=>|->|::|:=|<-|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|==|!=|<=|>=|[-+*/%&|^]=|&\^|\*\*|\.\.|<<|\n|\S"
_ASSIGN = "+= -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= &^= //= @="


def _one(*parts: str) -> re.Pattern:
    """A token as group 1, blanks before it skipped."""
    return re.compile(r"[^\S\n]*(" + "|".join(parts) + ")", re.M)


#: Operators and words that share a class; what the grammar names itself needs no entry.
CLASSES = {
    "js": {"BIN": "== != <= >= === !== / % ^ ?? << && || **", "PM": "+ -", "PRE": "~", "INC": "++ --", "ASG": _ASSIGN},
    "rs": {"BIN": "== != <= >= / % ^", "ASG": _ASSIGN, "DOTS": ".. ..= ..."},
    "java": {"BIN": "== != <= >= / % ^ << && ||", "PM": "+ -", "PRE": "! ~", "INC": "++ --", "ASG": _ASSIGN, "PRIM": "int long short byte char boolean float double", "MOD": "public private protected abstract native transient volatile strictfp"},
    "go": {"BIN": "== != <= >= / % << && || &^", "PM": "+ -", "INC": "++ --", "ASG": _ASSIGN},
    "c": {"BIN": "== != <= >= / % ^ | << >> && || < >", "PM": "+ -", "PRE": "! ~", "INC": "++ --", "ASG": _ASSIGN, "MOD": "static extern inline const volatile typedef restrict register auto _Noreturn _Thread_local _Atomic __inline __inline__ __restrict __restrict__ __const __volatile__ __extension__", "TYPE": "int char short long float double void signed unsigned _Bool _Complex bool"},
    "py": {"BIN": "== != <= >= % ^ | & << >> // < >", "PM": "+ -", "ASG": _ASSIGN},
    "rb": {"BIN": "== != <= >= > === / % ^ <=> =~ !~ >> && ", "PM": "+ -", "ASG": _ASSIGN, "DOTS": ".. ...", "VAR": "__FILE__ __LINE__ __dir__ __method__"},
}
CLASSES["ts"] = CLASSES["js"]
_SPLIT = {"js": {">>": ">>", ">>>": ">>>", "<-": "<-"}, "rs": {x: x for x in (">>", "<<", "**", "--", "<-")}, "java": {">>": ">>", ">>>": ">>>", "<-": "<-"}, "go": {">>": ">>", "**": "**"}}
_SPLIT["ts"] = _SPLIT["js"]
#: Words that a grammar names but that are no names themselves.
_PATTERNS = {
    "rs": _one(_MARK, r"\A#!(?!\[)[^\n]*", r"//[^\n]*", r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?s:.*?)\*/)*\*/", r"/\*", r'[bc]?r"[^"]*"', r'[bc]?r#"(?s:.*?)"#', r'[bc]?r##"(?s:.*?)"##', r'[bc]?r###"(?s:.*?)"###', r'[bc]?"(?:[^"\\]|\\(?s:.))*"', r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'", r"'[^\W\d]\w*", r"r#\w+", r"\$?[^\W\d]\w*(?:!(?=\s*(?:[(\[{]|[^\W\d]\w*\s*[(\[{])))?", r"\d(?:\w|\.(?=\d))*(?:(?<=[eE])[+-]\d\w*)?(?:\.(?![\w.]))?", r"\?", _OPS),
    "java": _one(r"[^\W\d$][\w$]*", _MARK, _SLASH, r'"""(?:[^\\]|\\(?s:.))*?"""', _STR, _CHR, r"@[ ]*(?!interface\b)[^\W\d][\w.]*", r"@[ ]*interface\b", r"\$[\w$]*", _NUM, _OPS),
    "go": _one(_NAME, _MARK, _SLASH, r"`[^`]*`", _STR, _CHR, _NAME, _NUM, _OPS),
    "c": re.compile("|".join((r"^[ \t]*#(?:[^\n\\]|\\(?s:.))*", r"[ \t]+", _MARK, _SLASH, r"(?:L|u8?|U)?" + _STR, r"(?:L|u8?|U)?" + _CHR, _NAME, r"\.?\d(?:[\w']|\.|(?<=[eEpP])[+-])*", r"\.\.\.|->|<<=|>>=|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|>>|\n|\S")), re.M),
    "js": _one(r"[^\W\d$][\w$]*", _MARK, _SLASH, r"\A#![^\n]*", _STR, _CHR, r"`(?:[^`\\$]|\\(?s:.)|\$(?!\{))*`?", r"@[^\W\d][\w$]*(?:\.[\w$]+)*", r"#[^\W\d$][\w$]*|#\$[\w$]*", r"\$[\w$]*", _NUM, _OPS),
    "py": _one(
        _MARK, r"#[^\n]*", r"\\\n", r"(?i:br?|rb?|u|fr?|rf?|tr?|rt?)?(?:\"\"\"(?:[^\\]|\\(?s:.))*?\"\"\"|'''(?:[^\\]|\\(?s:.))*?''')", r"\"\"\"|'''",
        r'(?i:f|fr|rf|t)"(?:[^"\\\n{]|\\.|\{\{|\{(?:[^{}"\n]|"[^"\n]*"|\{[^{}\n]*\})*\})*"', r"(?i:f|fr|rf|t)'(?:[^'\\\n{]|\\.|\{\{|\{(?:[^{}'\n]|'[^'\n]*'|\{[^{}\n]*\})*\})*'",
        r"(?i:br?|rb?|u|fr?|rf?|tr?|rt?)?(?:" + _STR + "|" + _CHR + ")", r"\n[ \t\f]*", r"[^\W\d][\w\u0300-\u036f\u0900-\u0dff\u0e31-\u0fff]*", r"0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?", r"\*\*=|//=|>>=|<<=|\.\.\.|!=|==|<=|>=|->|:=|[-+*/%&|^@]=|\*\*|//|<<|>>|\S",
    ),
    "rb": _one(
        _MARK, r"^=begin\b(?s:.*?)^=end\b[^\n]*", r"#[^\n]*", r"^__END__\n(?s:.*)", r"\\\n", r"%[wWiIqQrx]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>|\|[^|]*\||![^!]*!)[a-z]*",
        r'"(?:[^"\\#]|\\(?s:.)|#(?!\{)|#\{(?:[^{}"]|"(?:[^"\\]|\\.)*"|\{[^{}]*\})*\})*"', r"'(?:[^'\\]|\\(?s:.))*'", r"`[^`\n]*`", r"(?:(?<=[=(,~ ])|^)/(?![ /=])(?:[^/\\\n]|\\.)+/[imxounse]*",
        r"(?<![:\w?)\]]):(?:[^\W\d]\w*[?!=]?(?!:)(?!(?<==)>)|\"(?:[^\"\\]|\\.)*\"|\[\]=?|<=>|[=!]~|===?|[<>]=?|\*\*|[+\-!~]@?|[*/%&|^])", r"(?<![.&:\w@$?!])def[ \t]+(?:(?:self|[^\W\d]\w*)\.)?(?:[^\W\d]\w*(?:[?!](?!=)|=(?=[ ]*\()|=(?=[ ]*\w+\n))?|\[\]=?|<=>|===?|=~|![=~]?|\*\*|[+\-~]@?|[*/%&|^<>]=?|<<|>>|`)",
        r"(?<![.&])\b(?:__FILE__|defined\?)", r"[^\W\d]\w*[?!]?:(?![:\w])(?=[\s)\]},])", r"@{1,2}[^\W\d]\w*", r"\$(?:[^\W\d]\w*|\d+|\W)", r"[^\W\d]\w*(?:[?!](?![=~]))?", r"\d(?:\w|\.(?=\d)|(?<=[eE])[+-](?=\d))*", r"\?[^\s\w](?=[\s),])|(?<=[=(,\[ ])\?[a-zA-Z](?=[\s),\]])",
        r"&\.|<=>|===|=~|!~|\*\*=|\.\.\.|<<=|>>=|&&=|\|\|=|=>|->|::|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|\*\*|\.\.|<<|>>|\n|\S",
    ),
}
_PATTERNS["ts"] = _PATTERNS["js"]


class Codes(dict):
    """Token text to its character; comments to a blank, or a line end if they hold one. Texts seen are kept, up to a bound."""

    def __init__(self, lang: str, g: Grammar):
        super().__init__()
        self.lang, self.char = lang, {k: v for k, v in g.code.items()}
        self.own = {w: g.char(c) for c, ws in CLASSES[lang].items() for w in ws.split()}
        self.own |= {t: c for t, c in g.code.items() if not (t.isupper() and len(t) > 1 and t.isalpha()) or t == "BEGIN"}
        self.own |= {k: "".join(self.own.get(x) or g.char(x) for x in v) for k, v in _SPLIT.get(lang, {}).items()}
        self.own |= {ch: ch for ch in "()[]{}\x03\x04" if ch in g.close or ch in g.close.values()}
        self.g = g

    def __missing__(self, t: str) -> str:
        if len(self) > 200_000:
            self.clear()
        c = self.own.get(t)
        self[t] = c = self._class(t) if c is None else c
        return c

    def _class(self, t: str) -> str:
        g, h, lang = self.g.char, t[0], self.lang
        if t[:7] in ("<<<<<<<", ">>>>>>>", "|||||||", "=======") and len(t) >= 7:
            return MERGE
        if t == "\n":
            return LINE
        if h in " \t" and t.isspace():
            return " "
        if t[:2] in ("//", "/*") and lang not in ("py", "rb"):
            return NONE if t == "/*" else LINE if "\n" in t else " "
        if h == "#" or (lang == "c" and t.lstrip()[:1] == "#"):
            return " " if lang in ("py", "rb", "c") or t[:2] == "#!" else g("PRIV") if len(t) > 1 else NONE
        if lang == "rb" and (t[:6] in ("=begin", "__END_") or t == "\\\n"):
            return " "
        if h in "\"'`" or (h.isalpha() and t[-1] in "\"'#"):
            if lang == "rs" and h == "'" and t[-1:] != "'":
                return g("LIFE") if len(t) > 1 else NONE
            if len(t) < 2 or (h == "`" and t[-1] != h) or t in ('"""', "'''"):
                return NONE
            return g("TPL") if h == "`" and lang in ("js", "ts") else g("STR")
        if h.isdigit() or (h == "." and len(t) > 1 and t[1].isdigit()):
            if lang == "py" and h == "0" and t.replace("_", "").isdigit() and t.strip("0_"):
                return NONE  # octal digits without a prefix
            return g("NUM")
        if lang == "rs" and t[-1] == "!" and len(t) > 1:
            return g("MACRO")
        if lang == "rb":
            if t[-1] == ":" and len(t) > 1:
                return g("LABEL")
            if h == ":" and len(t) > 1:
                return g("SYM")
            if h in "@$" and len(t) > 1:
                return g("VAR")
            if h in "%/?" and len(t) > 1:
                return g("STR")
            if h.isupper():
                return g("CONST")
        if h == "@" and len(t) > 1:
            return g("ANN" if lang == "java" else "DECO")
        if h.isalpha() or h in "_$":
            return g("ID")
        return NONE


@lru_cache(maxsize=None)
def codes(lang: str) -> Codes:
    return Codes(lang, grammar(lang))


@lru_cache(maxsize=None)
def _opaque(lang: str) -> re.Pattern:
    g = grammar(lang).char
    if lang == "rs":
        return re.compile(f"(?:{g('MACRO')}(?:{g('ID')})?|#!?)[(\\[{{]")
    return re.compile("(?:" + "|".join(g(w) for w in ("__attribute__", "_Alignas", "asm", "typeof", "_Generic")) + f")(?:{g('MOD')}|{g('goto')})*\\(")


def _blank(s: str, lang: str) -> str:
    """Groups whose contents the grammar leaves open (macros, attributes) emptied; what is not closed stays."""
    out, last = [], 0
    pattern = _opaque(lang)
    while m := pattern.search(s, last):
        depth, at = 1, m.end()
        while depth and at < len(s):
            depth += (s[at] in "([{") - (s[at] in ")]}")
            at += 1
        out.append(s[last : m.end()])
        last = at - 1 if not depth else at
        if depth:
            out.append(s[m.end() :])
            break
    out.append(s[last:])
    return "".join(out)


def token_string(text: str, ext_lang: str, elements: bool = False) -> str:
    """The token string of a text. elements: the language has elements (JSX), which are read as calls."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    c = codes(ext_lang)
    if ext_lang in ("js", "ts"):
        tokens = None
        if "${" not in text and not (elements and _MARKUP.search(text)):  # nothing that needs the tokens before it
            tokens = _PATTERNS[ext_lang].findall(text)
            if "/" in tokens or "/=" in tokens:
                tokens = None
        s = "".join(map(c.__getitem__, tokens or _js(text, 0, _PATTERNS[ext_lang], c, elements)[1])).replace(" ", "")
        return re.sub("\n\n+", "\n", _after_dot(ext_lang).sub(r"\1" + c.g.char("ID"), s) if tokens else s)
    if ext_lang == "py":
        return _python(text, c)
    if ext_lang == "rb":
        return _ruby(text, c)
    s = "".join(map(c.__getitem__, _PATTERNS[ext_lang].findall(text))).replace(" ", "")
    if ext_lang == "go":
        return _go(s, c)
    s = s.replace("\n", "")
    if ext_lang == "java":
        return _after_dot(ext_lang).sub(r"\1" + c.g.char("ID"), s)
    return _blank(s, ext_lang)


@lru_cache(maxsize=None)
def _after_dot(lang: str) -> re.Pattern:
    """A dot and a word after it, which is a name whatever it says (but not Java's `new`)."""
    c = codes(lang)
    words = {v for k, v in c.own.items() if k[:1].isalpha() and not (lang == "java" and k == "new")}
    return re.compile("([." + c.own.get("?.", ".") + "]\n*)[" + re.escape("".join(words)) + "]")


@lru_cache(maxsize=None)
def _line_ends(lang: str) -> re.Pattern:
    g = grammar(lang).char
    ends = [g(w) for w in ("ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "INC")]
    return re.compile("(?<=[" + re.escape("".join(ends) + ")]}") + "])(?:\n+|$)")


def _go(s: str, c: Codes) -> str:
    return _line_ends("go").sub(";", s).replace("\n", "")


# ---- JavaScript and TypeScript ---------------------------------------------------------------------------------------

_BEFORE_ELEMENT = frozenset("return default => = ( ? : , && || ?? [ { case yield".split())
_OPERAND_WORDS = frozenset("return typeof case in of delete void instanceof new do else throw yield await extends".split())
#: Where an element may begin; whether it does is decided on tokens.
_MARKUP = re.compile(r"(?:\b(?:return|default|case|yield)|=>|[=(?:,&|{\[])\s*<(?:[A-Za-z]|>)")
_HEADS = frozenset(("if", "while", "for", "with"))
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*")
_TAG = re.compile(r"\s*(?:[^\W\d][\w$]*(?:[-.:][\w$]+)*)?")
_ATTRIBUTE = re.compile(r"\s*[^\W\d]?[\w$:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'))?")
_GAP = re.compile(r"(?:\s|/\*(?s:.*?)\*/|//[^\n]*)*")
_CHILDREN = re.compile(r"[^<{>}]*")


def _element(text: str, at: int, pattern: re.Pattern, c: Codes) -> tuple[int, list[str]] | None:
    """(end, tokens) of the element that begins at `at`, as the call it stands for: its name, then in parentheses the code
    between its braces. None if it has no end."""
    out, open_tags, first = ["x", "("], [], True

    def braces(at: int) -> int | None:
        end, tokens = _js(text, at + 1, pattern, c, True, True)
        tokens = [t for t in tokens if c[t] not in (" ", LINE)]
        if end is not None and tokens:
            out.extend([*tokens, ","])
        return end

    while first or open_tags:
        if not first:
            at = _CHILDREN.match(text, at).end()
            if text[at : at + 1] == "{":
                at = braces(at)
                if at is None:
                    return None
                continue
        first = False
        if text[at : at + 1] != "<":
            return None
        if text[at + 1 : at + 2] == "/":
            m = _TAG.match(text, at + 2)
            end = _GAP.match(text, m.end()).end()
            if text[end : end + 1] != ">" or not open_tags or open_tags.pop() != m[0].strip():
                return None
            at = end + 1
            continue
        m = _TAG.match(text, at + 1)
        at = m.end()
        while True:
            at = _GAP.match(text, at).end()
            if text[at : at + 1] == ">":
                open_tags.append(m[0].strip())
                at += 1
                break
            if text[at : at + 2] == "/>":
                at += 2
                break
            eq = re.compile(r"=\s*\{").match(text, at)
            if text[at : at + 1] == "{" or eq:
                at = braces(eq.end() - 1 if eq else at)
                if at is None:
                    return None
                continue
            a = _ATTRIBUTE.match(text, at)
            if a.end() == at:
                return None
            at = a.end()
    return at, [*(out[:-1] if out[-1] == "," else out), ")"]


def _divides(prev: str, closed_head: bool) -> bool:
    """Whether a slash after this token divides; otherwise it begins a regular expression."""
    if prev == ")":
        return not closed_head
    return bool(prev) and (prev[-1] in "]\"'`" or (prev[-1].isalnum() or prev[-1] in "_$") and prev not in _OPERAND_WORDS)


def _js(text: str, at: int, pattern: re.Pattern, c: Codes, elements: bool, inside: bool = False) -> tuple[int | None, list[str]]:
    """(end, tokens) from `at` on; inside: up to the brace that closes what was open at `at`. Templates with parts become
    groups of their parts, words after a dot names, a slash where an operand may stand begins a regular expression."""
    out, prev, depth, heads = [], "{" if inside else "", 0, []  # heads: whether an open round bracket stands behind if, while, for or with
    closed_head = False
    match, put = pattern.match, out.append
    while m := match(text, at):
        t, at = m[1], m.end()
        h = t[0]
        if h == "<" and elements and t == "<" and prev in _BEFORE_ELEMENT and text[at : at + 1] not in ("", " ", "="):
            found = _element(text, m.start(1), pattern, c)
            if found:
                at, own = found
                out.extend(own)
                prev = ")"
                continue
        elif h == "`" and text.startswith("${", at):
            put("\x03")
            while text.startswith("${", at):
                end, own = _js(text, at + 2, pattern, c, elements, True)
                if end is None:
                    put("\x01")
                    return (None if inside else len(text)), out
                out.extend(x for x in own if c[x] != LINE)
                put(",")
                at = _TEMPLATE.match(text, end).end()
            if text[at : at + 1] != "`":
                put("\x01")
                return (None if inside else len(text)), out
            at += 1
            put("\x04")
            prev = ")"
            continue
        elif h == "/" and t in ("/", "/=") and not _divides(prev, closed_head):
            r = _REGEX.match(text, m.start(1))
            if r:
                at = r.end()
                put("0")
                prev = "0"
                continue
        elif prev == "." or prev == "?.":
            if h.isalpha() or h in "_$":
                t = "x"
        elif h in "{}" and inside:
            depth += (h == "{") - (h == "}")
            if depth < 0:
                return at, out
        elif h == "(":
            heads.append(prev in _HEADS)
        elif h == ")":
            closed_head = bool(heads) and heads.pop()
        put(t)
        k = c[t]
        if k != " " and k != LINE:
            prev = t
    return (None if inside else at), out


# ---- Python ----------------------------------------------------------------------------------------------------------


def _python(text: str, c: Codes) -> str:
    """Line ends and blocks as tokens; a block opens where a line stands deeper, and must close at an open level."""
    nl = c.g.char("NL")
    out, line, depth, levels, pending = [], [], 0, [0], 0
    for t in _PATTERNS["py"].findall("\n" + text + "\n"):
        if t[0] == "\n":
            if depth:
                continue
            if line:
                if pending > levels[-1]:
                    out.append("\x05")
                    levels.append(pending)
                else:
                    while pending < levels[-1]:
                        levels.pop()
                        out.append("\x06")
                    if pending != levels[-1]:
                        out.append(NONE)
                out += line
                out.append(nl)
                line = []
            pending = sum(8 - k % 8 if ch == "\t" else 1 for k, ch in enumerate(t[1:].replace("\f", "")))
        elif t[0] != "#" and t != "\\\n":
            line.append(c[t])
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth = max(0, depth - 1)
    out += line  # an open bracket: the rest of the file is one line
    out.append("\x06" * (len(levels) - 1))
    return "".join(out)


# ---- Ruby ------------------------------------------------------------------------------------------------------------

_HEREDOC = re.compile(r"<<([~-]?)(['\"`]?)([A-Z_][A-Za-z0-9_]*)\2")
_ENDLESS = re.compile(r"[ \t]*(?:\((?:[^()\n]|\([^()\n]*\))*\))?[ \t]*=(?![=~>])")
_OPENERS = {"class": "class", "module": "module", "if": "if", "unless": "if", "while": "while", "until": "while", "for": "for", "case": "case", "begin": "begin", "do": "do"}
#: Tokens after which an operand is still to come, so that `if` opens a block and a line end ends nothing.
_AWAITS = frozenset("= ( [ { , | || && ! ? : => -> + - * / % ** == != <= >= < > << >> <=> =~ !~ ^ & ~ += -= *= /= ||= &&= |= &= <<= .. ... and or not . &. ::".split())


def _heredocs(text: str) -> str:
    """The bodies of here-documents cut out, their marks made strings."""
    out, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        i += 1
        tags = [(m[1], m[3]) for m in _HEREDOC.finditer(line)] if "<<" in line else []
        for dash, tag in tags:
            end = next((k for k in range(i, len(lines)) if (lines[k].strip() if dash else lines[k]) == tag), None)
            if end is None:
                break
            i = end + 1
            line = _HEREDOC.sub('""', line, count=1)
        out.append(line)
    return "\n".join(out)


def _ruby(text: str, c: Codes) -> str:
    """Words that open a block become brackets closed by `end`; what only modifies a statement becomes `ifmod`. Line ends
    that end no statement are dropped, a loop's own `do` is `loopdo`."""
    g = c.g
    nl, opening = g.char("NL"), {w: g.brackets[b][0] for w, b in _OPENERS.items()}
    out: list[str] = []
    prev, loops, depth = "\n", [], 0  # loops: depths of brackets at which a loop's own do may come
    if "<<" in text:
        text = _heredocs(text)
    tokens = [m for m in _PATTERNS["rb"].finditer(text)]
    n = len(tokens)
    for i, m in enumerate(tokens):
        t = m[1]
        k = c[t]
        if k == " ":
            continue
        if t == "\n" or t == ";":
            ahead = i + 1
            while ahead < n and (c[tokens[ahead][1]] in (" ", LINE)):
                ahead += 1
            after = tokens[ahead][1] if ahead < n else ""
            if t == "\n" and (prev in _AWAITS and not (prev in ("|", "||", "?", "!", "*", "&") and prev != "||") or after in (".", "&.") and not text.startswith("..", tokens[ahead].start(1))):
                if prev != "|" or True:
                    if prev not in ("{", "(", "["):
                        continue
            out.append(nl)
            prev = "\n"
            if loops and loops[-1] == depth:
                loops.pop()
            continue
        word = t.isidentifier()
        if word and prev in (".", "&.", "::") and t not in ("self",):
            out.append(g.char("ID") if not t[0].isupper() else g.char("CONST"))
            prev = "x"
            continue
        if t[:4] in ("def ", "def\t"):
            if _ENDLESS.match(text, m.end()):
                out.append(g.char("EDEF"))
            else:
                out.append(g.brackets["def"][0] + g.char("DEF"))
            prev = "def"
            continue
        if t in opening:
            starts = prev in _AWAITS or prev in ("\n", "then", "else", "do", "begin", "ensure", "elsif", "when", "in", "while", "until", "if", "unless", "def", "private", "public") or (prev == ":")
            if t in ("if", "unless", "while", "until") and not starts:
                out.append(g.char("ifmod"))
            elif t == "do" and loops and loops[-1] == depth:
                loops.pop()
                out.append(g.char("loopdo"))
            else:
                out.append(opening[t])
                if t in ("while", "until", "for"):
                    loops.append(depth)
            prev = t
            continue
        if t == "end":
            out.append("\x1f")
            prev = "x"
            continue
        depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
        out.append(k)
        prev = t if not word or t in ("then", "else", "ensure", "elsif", "when", "in", "and", "or", "not", "private", "public", "return", "next", "break") else "x"
    return "".join(out)
