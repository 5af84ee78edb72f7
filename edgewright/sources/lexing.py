"""Lexers: source text to tokens and their classes, one character each, for extraction and documentation.

Classes (fixed values of this module): i name, w word that may be a name or a keyword, 0 number, s string or regular
expression, brackets and , ; . : ? as they are, = assignment, b binary operator, o prefix or binary operator,
* star, u prefix operator, p ++ or --, g angle bracket, a =>, t ->, d ::, e dots, @ annotation, # attribute mark,
P directive line, K keyword that begins something, k keyword between things, c keyword before a parenthesis, X what is no token, M merge marker. Only for some languages: F item keyword, V visibility, Q package, I import, C class-like
keyword, m modifier; Python: H block keyword, h except or finally, l else or elif; Ruby: O and F open blocks, E ends them.
"""

from __future__ import annotations

import re

_MARK = r"^(?:<{7}|>{7}|\|{7}|={7})(?![<>|=])[^\n]*"
_NUM = r"\.?\d(?:\w|\.(?=\d)|(?<=[eE])[+-](?=\d))*"
_STR = r'"(?:[^"\\\n]|\\(?s:.))*"'
_CHR = r"'(?:[^'\\\n]|\\(?s:.))*'"
_SLASH = r"//[^\n]*|/\*(?s:.*?)\*/|/\*"
_OPS = r">>>=|===|!==|\*\*=|\.\.\.|\.\.=|<<=|>>=|&&=|\|\|=|\?\?=|>>>|=>|->|::|:=|<-|\+\+|--|&&|\|\||\?\?|\?\.|==|!=|<=|>=|[-+*/%&|^]=|\*\*|\.\.|<<|[-+*/%&|^!~<>=?:;,.()\[\]{}@#]|\n|\S"


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_EXACT = {t: t for t in "()[]{},;.:?*@#\n"}
_EXACT |= dict.fromkeys("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= :=".split(), "=")
_EXACT |= dict.fromkeys("== != <= >= === !== / % ^ | ?? << && || >>> ".split(), "b")
_EXACT |= dict.fromkeys("+ - & ** <-".split(), "o") | dict.fromkeys("! ~".split(), "u") | dict.fromkeys("++ --".split(), "p")
_EXACT |= dict.fromkeys("< > >>".split(), "g") | {"=>": "a", "->": "t", "::": "d", "...": "e", "..": "e", "..=": "e", "?.": "."}


class Classes(dict):
    """Token text to class; what is not listed is classed by its first characters and kept for the next time."""

    def __init__(self, exact: dict[str, str], words: dict[str, str], first: dict[str, str]):
        super().__init__(_EXACT | exact)
        self.fixed = _EXACT | exact
        self.words, self.first = {w: c for c, ws in words.items() for w in _words(ws)}, first

    def __missing__(self, t: str) -> str:
        if len(self) > 200_000:  # strings and comments of many files: forget them
            self.clear()
            self.update(self.fixed)
        h = t[0]
        c = self.words.get(t)
        if c is None:
            if t[:7] in ("<<<<<<<", ">>>>>>>", "|||||||", "======="):
                c = "M"
            elif h.isalpha() or h in "_$":
                c = "s" if t[-1] in "\"'`" and len(t) > 1 and not t[-2:].isalnum() else "i"
            elif h.isdigit() or (h == "." and len(t) > 1 and t[1].isdigit()):
                c = "0"
            elif h in "\"'`":
                c = "s" if len(t) > 1 and t[-1] == h else self.first.get(h, "X")
            else:
                c = self.first.get(t[:2]) or (self.first.get(h) if len(t) > 1 else None) or "X"
        self[t] = c
        return c


def _one(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts), re.M)


_COMMENT = {"//": " ", "/*": " "}
_JS_WORDS = {
    "K": "function class const var return throw new typeof delete void import export default case break continue debugger do try finally else let catch",
    "k": "in instanceof extends",
    "c": "if for while switch with",
    "w": "async of from as get set static yield await target",
}
_TS_WORDS = _JS_WORDS | {"w": _JS_WORDS["w"] + " readonly private protected public abstract declare namespace module type interface keyof infer is asserts override satisfies unique global enum implements out accessor constructor unknown never any object"}
_JS = _one(
    _MARK, _SLASH, r"\A#![^\n]*", _STR, _CHR, r"`(?:[^`\\]|\\(?s:.))*`",
    r"(?<=[=(,:\[!&|?{};\n+])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", r"(?<=return) /(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*",
    r"@[^\W\d][\w.]*", r"#[^\W\d]\w*", r"[^\W\d$]\w*(?:\$\w*)*|\$[\w$]*", _NUM, _OPS,
)
_JS_FIRST = _COMMENT | {"#!": " ", "@": "@", "#": "i", "/": "s", " ": "s", "\t": "s"}
LEXERS: dict[str, tuple[re.Pattern, Classes]] = {
    "js": (_JS, Classes({}, _JS_WORDS, _JS_FIRST)),
    "ts": (_JS, Classes({}, _TS_WORDS, _JS_FIRST)),
    "rs": (
        _one(_MARK, _SLASH, r'b?r"[^"]*"', r'b?r#"(?s:.*?)"#', r'b?r##"(?s:.*?)"##', r'[bc]?"(?:[^"\\]|\\(?s:.))*"', r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'", r"'[^\W\d]\w*", r"r#\w+", r"\$?[^\W\d]\w*(?:!(?=\s*(?:[(\[{]|\w+\s*\{)))?", r"\d(?:\w|\.(?=\d))*", _OPS),
        Classes(
            {"|": "o", "||": "o", "&&": "o", "macro_rules!": "F"},
            {"F": "use fn impl struct enum trait mod const static type extern unsafe async union", "V": "pub", "w": "crate", "K": "let return if while loop match for move mut ref dyn box break continue else where as in await yield", "k": ""},
            _COMMENT | {"'": "w"},
        ),
    ),
    "java": (
        _one(_MARK, _SLASH, r'"""(?s:.*?)"""', _STR, _CHR, r"@(?!interface\b)[^\W\d][\w.]*", r"@interface\b", r"[^\W\d]\w*", _NUM, _OPS),
        Classes(
            {"@interface": "C"},
            {"Q": "package", "I": "import", "C": "class interface enum", "m": "public private protected static final abstract native synchronized transient volatile strictfp sealed", "K": "return throw new case break continue do try finally else assert", "k": "instanceof extends implements throws", "c": "if for while switch catch", "w": "default record var yield permits non when module"},
            _COMMENT | {"@": "@"},
        ),
    ),
    "go": (
        _one(_MARK, _SLASH, r"`[^`]*`", _STR, _CHR, r"[^\W\d]\w*", _NUM, _OPS),
        Classes({}, {"Q": "package", "I": "import", "F": "func", "V": "type var const", "K": "if for switch select case default go defer struct interface map chan range else goto", "w": "return break continue fallthrough"}, _COMMENT),
    ),
    "c": (
        _one(_MARK, _SLASH, r"^[ \t]*#(?:[^\n\\]|\\(?s:.))*", r"(?:L|u8?|U)?" + _STR, r"(?:L|u8?|U)?" + _CHR, r"[^\W\d]\w*", _NUM, _OPS),
        Classes({}, {"m": "static extern inline const volatile register typedef unsigned signed long short restrict _Noreturn auto", "C": "struct union enum", "K": "return goto case default break continue do else sizeof", "c": "if for while switch"}, _COMMENT | {"#": "P", " ": "P", "\t": "P"}),
    ),
    "py": (
        _one(_MARK, r"#[^\n]*", r"\\\n", r"(?i:[rbuft]{0,2})(?:\"\"\"(?:[^\\]|\\(?s:.))*?\"\"\"|'''(?:[^\\]|\\(?s:.))*?''')", r"\"\"\"|'''", r"(?i:[rbuft]{0,2})(?:" + _STR + "|" + _CHR + ")", r"\n[ \t\f]*", r"[^\W\d]\w*", _NUM, _OPS.replace(r"\n|", r"//=|//|@=|")),
        Classes(
            {"//": "b", "@": "b", "//=": "=", "@=": "=", "|": "b", "!": "X", "?": "X", "++": "o", "--": "o", "&&": "X", "||": "X", "===": "X", "=>": "X", "::": ":", ";": ";", "~": "u", '"""': "X", "'''": "X", "^": "b"},
            {"H": "def class if elif else for while with try except finally", "k": "in is and or as import from", "u": "not", "K": "return raise assert del global nonlocal async", "i": "pass break continue", "w": "match case type print lambda yield await"},
            {"#": " ", "\\\n": " "},
        ),
    ),
    "rb": (
        _one(_MARK, r"^=begin\b(?s:.*?)^=end\b[^\n]*", r"#[^\n]*", r"^__END__\n(?s:.*)", r"<<[~-]?(['\"]?)(?P<tag>[A-Z_]+)\1[^\n]*\n(?s:.*?)^[ \t]*(?P=tag)$", r"%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})", r'"(?:[^"\\]|\\(?s:.))*"', r"'(?:[^'\\]|\\(?s:.))*'", r"`[^`\n]*`", r"(?<=[=(,~ ])/(?![ /=])(?:[^/\\\n]|\\.)+/[imx]*", r"(?<![:\w?)\]]):(?:[^\W\d]\w*[?!=]?(?!:)|\"[^\"\n]*\")", r"(?<![.&])\b(?:__FILE__|defined\?)", r"(?<=def )\w+=(?=\()", r"[@$]{0,2}[^\W\d]\w*[?!]?:(?![:\w])|[@$]{0,2}[^\W\d]\w*(?:[?!](?!=))?", r"\$[\W\d]", _NUM, r"&\.|<=>|=~|!~", _OPS),
        Classes(
            {"|": "o", "||": "o", "&.": ".", "<=>": "b", "=~": "b", "!~": "b", "<<": "b"},
            {"F": "def", "O": "class module begin case", "o": "not", "c": "if unless while until for", "y": "do", "E": "end", "k": "and or in then rescue ensure else elsif when", "K": "return yield raise alias undef defined? next break"},
            {"#": " ", "=b": " ", "__": " ", "<<": "s", "%": "s", "/": "s", ":": "s", "@": "i", "$": "i"},
        ),
    ),
}
_PLAIN = "break continue do else try finally throw return new case"
LEXERS |= {
    "cpp": (LEXERS["c"][0], Classes({}, {"m": "static extern inline const volatile virtual explicit constexpr unsigned signed long short auto template typename friend using typedef public private protected mutable", "C": "struct union enum class namespace", "K": _PLAIN + " sizeof delete goto default", "c": "if for while switch catch"}, _COMMENT | {"#": "P", " ": "P", "\t": "P"})),
    "cs": (_one(_MARK, _SLASH, r'[$@]{0,2}"(?:[^"\\\n]|\\(?s:.))*"', _CHR, r"^[ \t]*#[^\n]*", r"@?[^\W\d]\w*", _NUM, _OPS), Classes({}, {"C": "class struct interface enum record namespace", "m": "public private protected internal static readonly const virtual override sealed abstract async partial", "K": _PLAIN + " using", "c": "if for foreach while switch catch lock"}, _COMMENT | {"#": "P", " ": "P", "$": "s"})),
    "php": (_one(_MARK, _SLASH, r"#[^\n]*", r"<\?(?:php|=)?|\?>", _STR, r"'(?:[^'\\]|\\(?s:.))*'", r"\$?[^\W\d][\w\\]*", _NUM, _OPS), Classes({"<?php": ";", "?>": ";", "<?=": ";"}, {"C": "class interface trait enum namespace", "F": "function fn", "m": "public private protected static final abstract", "K": _PLAIN + " echo use", "c": "if for foreach while switch catch"}, _COMMENT | {"#": " "})),
    "swift": (_one(_MARK, _SLASH, r'"""(?s:.*?)"""', _STR, r"@[^\W\d]\w*", r"#[^\W\d]\w*", r"[^\W\d]\w*", _NUM, _OPS), Classes({}, {"C": "class struct enum protocol extension", "F": "func", "m": "public private internal static final override mutating open lazy weak", "K": _PLAIN + " let var guard if for while switch in"}, _COMMENT | {"@": "@", "#": "i"})),
}
LANGUAGE = {"rs": "rs", "py": "py", "js": "js", "jsx": "js", "ts": "ts", "tsx": "ts", "java": "java", "go": "go", "c": "c", "h": "c", "rb": "rb"}
