"""Lexers with a pushdown stack for the languages of problem 1.

`problem(language, content)` names the first syntactic fault of a text, or gives None. Each lexer takes the
text token by token, holds open brackets, templates, indentations or blocks on a stack, and writes a
skeleton in which comments are blanks and literals are one mark each. What the stack leaves open is a
premature end; what no token explains is an unterminated literal, a stray mark or a merge conflict. On the
skeleton, rules of each language say which neighbours cannot stand together.
"""

from __future__ import annotations

import re
from collections.abc import Callable

CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?:[ \r\n]|$)|^={7}\r?$", re.M)
PAIR = {")": "(", "]": "[", "}": "{"}


class Fault(Exception):
    """Raised where the text stops being valid."""


# --- languages with braces -------------------------------------------------------------------------------------------

_COMMENT = r"(?P<c>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<bad>/\*)"
_QUOTED = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
_BRACKET = r"(?P<b>[()\[\]{}])"
SCAN = {
    "javascript": re.compile(rf"{_COMMENT}|(?P<s>{_QUOTED}|{_SINGLE})|(?P<t>`)|{_BRACKET}|(?P<d>/)|(?P<u>[\"'])"),
    "go": re.compile(rf"{_COMMENT}|(?P<s>{_QUOTED.replace('[\\s\\S]', '[^\\n]')}|`[^`]*`|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)')|{_BRACKET}|(?P<o>/)|(?P<u>[\"'`])"),
    "java": re.compile(rf'{_COMMENT}|(?P<s>"""[ \t\f]*\r?\n(?:[^\\"]|\\[\s\S]|"(?!""))*"""|{_QUOTED.replace("[\\s\\S]", "[^\\n]")}|\'(?:[^\'\\\n]|\\(?:u+[0-9a-fA-F]{{4}}|[0-7]{{1,3}}|.))\')|{_BRACKET}|(?P<o>/)|(?P<u>["\'])'),
    "rust": re.compile(rf"(?P<c>//[^\n]*)|(?P<n>/\*)|(?P<s>b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:u\{{[0-9a-fA-F_]+\}}|x[0-9a-fA-F]{{2}}|.))')|(?P<l>'[A-Za-z_]\w*(?!'))|{_BRACKET}|(?P<u>[\"'])"),
    "c": re.compile(rf"{_COMMENT}|(?P<s>{_QUOTED}|{_SINGLE})|{_BRACKET}|(?P<o>/)|(?P<u>[\"'])"),
}
#: All but Rust, whose literals begin with letters, skip to the next mark that matters.
_SKIP = r"[^\"'`/()\[\]{}]*"
SCAN = {name: scan if name == "rust" else re.compile(f"{_SKIP}(?:{scan.pattern})") for name, scan in SCAN.items()}
SCAN["typescript"] = SCAN["javascript"]
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_REGEX_AFTER = re.compile(r"(?:^|[^\w$)\]}\"\s]|\b(?:return|typeof|case|in|of|void|delete|do|else|throw|new|await|yield))\s*$")
_TAGGED = re.compile(r"[\w$)\]]$")
_RUST_BLOCK = re.compile(r"/\*|\*/")


def skeleton(language: str, text: str) -> str:
    """The text with blanks for comments and `""` for literals; raises Fault where brackets or literals do not close."""
    find, out, stack, at, n = SCAN[language].search if language == "rust" else SCAN[language].match, [], [], 0, len(text)
    while at < n:
        m = find(text, at)
        if m is None:
            break
        kind = m.lastgroup
        if kind == "h":
            kind = "s"
        out.append(text[at : m.start(kind)])
        at = m.end()
        if kind == "b":
            mark = m["b"]
            out.append(mark)
            if mark in "([{":
                stack.append(mark)
            elif not stack:
                raise Fault(f"unbalanced {mark}")
            else:
                top = stack.pop()
                if top == "`" and mark == "}":
                    out[-1] = ") "
                    at = _template(text, at, stack, out)
                elif top != PAIR[mark]:
                    raise Fault(f"unbalanced {mark}")
        elif kind == "s":
            out.append('""')
        elif kind == "c":
            out.append("\n" if "\n" in m["c"] else " ")
        elif kind == "l":
            out.append("'")
        elif kind == "t":
            tail = "".join(out[-2:])[-12:]
            out.append(".raw" if _TAGGED.search(tail) and not _REGEX_AFTER.search(tail) else '""')
            at = _template(text, at, stack, out)
        elif kind == "d":
            before = "".join(out[-3:])[-80:]
            literal = _REGEX.match(text, m.start("d")) if _REGEX_AFTER.search(before) else None
            if literal:
                at = literal.end()
                out.append('""')
            else:
                out.append("/")
        elif kind == "n":
            depth = 1
            while depth:
                mark = _RUST_BLOCK.search(text, at)
                if mark is None:
                    raise Fault("unterminated comment")
                depth += 1 if mark[0] == "/*" else -1
                at = mark.end()
            out.append(" ")
        elif kind == "o":
            out.append("/")
        else:
            raise Fault("unterminated literal or comment")
    out.append(text[at:])
    if stack:
        raise Fault(f"premature end: {stack[-1]} is open")
    return "".join(out)


def _template(text: str, at: int, stack: list[str], out: list[str]) -> int:
    chunk = _TEMPLATE.match(text, at)
    if chunk is None:
        raise Fault("unterminated template")
    if chunk[1] != "`":
        stack.append("`")
        out.append(" + (")
    return chunk.end()


# The words of each language that are not names.
_JS = "const let var function class extends return throw new typeof instanceof in of void delete await async yield case default else do import export from as static get set if for while switch try catch finally with break continue debugger using accessor this super null true false"
_TS = _JS + " type interface enum implements public private protected readonly abstract declare namespace module keyof is infer override satisfies asserts unique global out"
WORDS = {
    "javascript": set(_JS.split()),
    "typescript": set(_TS.split()),
    "go": set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "java": set("abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while var record sealed permits yield when module requires exports opens uses provides with to open transitive non".split()),
    "rust": set("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type union unsafe use where while yield auto default macro_rules try macro raw safe".split()),
    "c": set("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while".split()),
}
# The marks after which a value must follow.
_COMMON = "= == != / % && || += -= /= %= |= ^= <<= >>= <= >="
WANTS = {
    "javascript": set(f"{_COMMON} + - === !== ?? ??= &&= ||= *= **= => < & | ^ << >> ** *".split()),
    "typescript": set(f"{_COMMON} + - === !== ?? ??= &&= ||= *= **= => & | ^ <<".split()),
    "go": set(f"{_COMMON} + - := *= < > & | ^ << >> &^".split()),
    "java": set(f"{_COMMON} + - *= -> & | ^ <<".split()),
    "rust": set(f"{_COMMON} *= => ->".split()) - {"||", "&&"},
    "c": set(f"{_COMMON} + - *= < > | ^ << >>".split()),
}
# Of these the marks that also stand before a value, or begin a type or pattern.
PREFIX = {"javascript": {"+", "-", "<", "*"}, "typescript": {"+", "-", "&", "|", "<"}, "go": {"+", "-", "&", "^", "<"}, "java": {"+", "-"}, "rust": {"|", "||", "&&", "<"}, "c": {"+", "-", "&&"}}
# The marks after which the name of a member stands, whatever word that is, and what else may stand there.
MEMBER = {"javascript": {".", "?."}, "typescript": {".", "?."}, "go": {"."}, "java": {".", "::"}, "rust": {".", "::"}, "c": {".", "->"}}
AFTER_MEMBER = {"javascript": "ws([#!", "typescript": "ws([#!<", "go": "w(", "java": "w<*@", "rust": "wn<({*$i", "c": "w*~o"}
# Words that only begin a statement or declaration, and so never are a value.
BEGINS = {
    "javascript": set("const let var return throw if for while switch try do export break continue else case default catch finally".split()),
    "go": set("if for return switch var const type defer go break continue else case default import package goto".split()),
    "java": set("if for while return try throw public private protected import package break continue else case do catch finally class interface".split()),
    "rust": set("let fn pub use impl struct enum mod trait else".split()),
    "c": set("if for while return switch static break continue do else case default typedef goto".split()),
}
BEGINS["typescript"] = BEGINS["javascript"]
_WORD_MARK = r"[A-Za-z_$\u0080-\U0010ffff][\w$]*|\d\w*(?:\.\d\w*|\.(?![.\w])|\.(?:[fFdDlL]|[eE]\d+)(?!\w))?"
_TOKEN = re.compile(_WORD_MARK + r"|\"\"|\n|\.\.\.|\.\.=?|&&=|\|\|=|\?\?=|===|!==|\*\*=|<<=|>>=|>>|&\^=?|::|:=|=>|->|<-|\?\?|\?\.(?!\d)|&&|\|\||[=!<>+\-*/%&|^]=|\+\+|--|<<|\*\*|[^\s\w]")
# The forms of numbers.
_DIGITS = r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE]\d*)?"
NUMBER = {
    "javascript": re.compile(rf"(?:{_DIGITS})n?$"),
    "go": re.compile(rf"(?:{_DIGITS}|0[xX][\da-fA-F_.]*[pP]\d*)i?$"),
    "java": re.compile(rf"(?:{_DIGITS}|0[xX][\da-fA-F_.]*[pP]\d*)[lLfFdD]?$"),
    "rust": re.compile(rf"(?:{_DIGITS})_*(?:[iu](?:8|16|32|64|128|size)|f(?:16|32|64|128))?$"),
    "c": re.compile(r"(?:0[xX][\da-fA-F']+|0[bB][01']+|\d[\d']*(?:\.\d*)?(?:[eE]\d*)?|0[xX][\da-fA-F.]*[pP]\d*)\w{0,6}$"),
}
NUMBER["typescript"] = NUMBER["javascript"]
#: Marks that have no place in a language.
STRAY = {
    "javascript": {"::", ":=", "->", "\\", "@"},
    "typescript": {"::", ":=", "->", "\\"},
    "go": {"::", "->", "=>", "\\", "@", "#", "?", "$", "===", "!==", "??", "?.", "**"},
    "java": {":=", "=>", "\\", "#", "`", "===", "!==", "??", "?.", "$", "**"},
    "rust": {":=", "\\", "`", "++", "===", "!=="},
    "c": {":=", "=>", "::", "`", "@", "$", "===", "!==", "..", "..="},
}
# Token classes: w name, u name in capitals, n number, s literal, k word of the language, B word that begins a statement
# (P one that needs a parenthesis, V a declaration, T try, E else), F function, I import, o mark that wants a value, y such
# a mark that may also stand before one, q the equals sign, m member mark, e three dots, ! stray, x other, $ the end;
# brackets, semicolon, colon and comma stand for themselves.
# PAIRS: what cannot follow a class at all; SAME_LINE: what cannot follow it on its line.
_WANTING = "o)];,}:$BPVTE"
PAIRS = {
    "javascript": {"o": _WANTING, "q": _WANTING + "q", "y": ");]}$", "V": ";)q}m", "E": ")}]:", "T": "wunsk(;)}],", "P": "wunsk{;)}],$q", "(": ",", "{": "", ",": ";", "e": ")]}qo,;"},
    "go": {"o": _WANTING, "q": _WANTING + "q", "y": ");]}$", "(": ",", "[": ",", ",": ",;", "{": ",e"},
    "java": {"o": _WANTING.replace("B", ""), "q": _WANTING + "q", "y": ");]}$", "P": "wunsk{;)}],$q", "(": ",", "[": ",", ",": ",;)", "{": "e", "C": "{(;)"},
    "rust": {"o": ")];,}:$", "q": ")];,:$q", "(": "", ",": ",;", "{": ""},
    "c": {"o": _WANTING, "q": _WANTING + "q", "y": "];}$", "P": "wuns{;)}],$q", "[": ",", "{": "e"},
}
PAIRS["typescript"] = PAIRS["javascript"]
SAME_LINE = {
    "javascript": {"w": "wuns", "u": "wuns", "n": "wunsB", "s": "wuns", "]": "wuns"},
    "go": {"w": "n", "u": "n", "n": "wuk", "s": "wuns"},
    "java": {"w": "n", "u": "n", "n": "wukB", "s": "wunsB", "]": "ns"},
    "rust": {"w": "wuns", "u": "wuns", "n": "wun", "s": "wuns", "]": "s"},
    "c": {"w": "n", "u": "n", "n": "w", "]": "s"},
}
SAME_LINE["typescript"] = SAME_LINE["javascript"]
#: Three classes in a row on a line that no language allows.
TRIPLES = {"java": {a + b + c for a in "wu" for b in "wu" for c in "wuns"} | {"w" + b + "s" for b in "wu"}, "go": {a + b + c for a in "wu" for b in "wu" for c in "wu"}, "c": {a + "ww" for a in "w"}}
_KNOWN: dict[str, dict[str, str]] = {}


def _classes(language: str) -> dict[str, str]:
    known = {"\n": "N", '""': "s", "...": "e", **{c: c for c in "()[]{};,:#<*@~$"}}
    known |= dict.fromkeys(WORDS[language], "k") | dict.fromkeys(BEGINS[language], "B")
    known |= {mark: "y" if mark in PREFIX[language] else "o" for mark in WANTS[language]} | dict.fromkeys(MEMBER[language], "m") | dict.fromkeys(STRAY[language], "!")
    known["="] = "q"
    if language not in ("c", "go"):
        known[">>"] = known[">>="] = "x"  # the end of two lists of types
    if language == "java":
        known |= {"class": "C", "interface": "C"}
    if language in ("javascript", "typescript"):
        known |= {"const": "V", "let": "V", "var": "V", "function": "F", "try": "T", "else": "E", "import": "I", "case": "k", "default": "k"}
    if language not in ("go", "rust"):
        known |= {"if": "P", "while": "P", "switch": "P"}
    if language in ("javascript", "typescript"):
        known |= {"<": "<", "$": "w"}
    if language == "rust":
        known |= {"?": "x", "?.": "m", "??": "x", "<<": "<"}
    return known


def _class_of(token: str, language: str) -> str:
    if token[0].isdigit():
        return "n" if NUMBER[language].match(token) else "!"
    if token[0].isalpha() or token[0] in "_$":
        return "u" if token.isupper() else "w"
    return "!" if token[0] > "\x7f" else "x"


_ELEMENT = re.compile(r"(?:\breturn|=>|[=(,?:&|>])\s*<(?:[A-Za-z][\w.]*(?:\s+[\w-]+=|\s*/?>)|>)")


class _Frame:
    """An open bracket: its mark, what it holds, and what is open or counted in it."""

    __slots__ = ("mark", "kind", "questions", "semicolons", "cases", "infix", "statement")

    def __init__(self, mark: str, kind: str):
        self.mark, self.kind, self.questions, self.semicolons, self.cases, self.infix, self.statement = mark, kind, 0, 0, 0, False, ""


def _automaton(language: str, shape: str) -> None:
    """The pushdown automaton on the tokens of the skeleton: each token's class depends on the state and on the top of the stack.

    Raises where a token cannot follow the one before it in its frame. Frames are blocks, objects, classes, parentheses of
    calls, controls and loops, and indexes.
    """
    known = _KNOWN.get(language)
    if known is None or len(known) > 200_000:
        known = _KNOWN[language] = _classes(language)
    tokens = _TOKEN.findall(shape)
    if language == "javascript" and _ELEMENT.search(shape):
        return  # elements of markup in the code: their text has no tokens
    for token in set(tokens).difference(known):
        known[token] = _class_of(token, language)
    script, plain = language in ("javascript", "typescript"), language == "javascript"
    never, same_line, triples, after_member = PAIRS[language], SAME_LINE[language], TRIPLES.get(language, ()), AFTER_MEMBER[language]
    frame = _Frame("", "block")
    stack: list[_Frame] = []
    before2, before, word2, word, opened, line, line2 = ";", ";", "", "", "", True, True  # classes and words before; what a word said about the next brace
    count = len(tokens)

    def fault(i: int) -> Fault:
        return Fault("misplaced: " + " ".join(tokens[max(0, i - 3) : i + 1])[-40:].replace("\n", " ").strip())

    for i, token in enumerate(tokens):
        kind = known[token]
        if kind == "N":
            line = True
            continue
        if frame.kind == "macro" and kind not in "()[]{}":
            before2, before, word2, word, line = before, "x", word, token, False
            continue
        if kind == "!":
            raise fault(i)
        wordy = token[0].isalpha() or token[0] in "_$"
        if before == "m":
            if wordy:
                kind = "w"
            elif kind == "n" and before2 not in "wuns)]":
                pass  # a number that begins with its point
            elif kind not in after_member:
                raise fault(i)
        elif wordy and kind not in "wu":
            after = tokens[i + 1] if i + 1 < count else ""
            if script and (after in (":", ",", "=", "}", "?", ")") and before in "{,;}" and frame.kind in ("object", "class") or after in ("(", "<") and frame.kind in ("object", "class") and (before in "{,;}" or line or word in ("static", "async", "get", "set", "*", "public", "private", "protected")) and token != "function"):
                kind = "w"
            elif script and (word == "as" or before == "<" or word in ("enum",) or before == "#"):
                kind = "k"
            elif language == "java" and before == "m":
                kind = "w"
        if frame.kind == "macro":
            pass
        elif not (line and before in "wunsk])}"):
            pairs = never.get(before)
            if pairs and kind in pairs and not (language == "rust" and kind == "B"):
                raise fault(i)
        elif kind in ("o",) and before in "oq":
            raise fault(i)
        if not line and frame.kind != "macro":
            pairs = same_line.get(before)
            if pairs and kind in pairs and not (script and word in _SOFT[language]):
                raise fault(i)
            if triples and not line2 and before2 + before + kind in triples and not (language == "c" and (frame.kind == "list" or word2[0] == "_" or tokens[i + 1 : i + 2] == ["("])):
                raise fault(i)
        if script and (token == "*" and before in "oqy" or before == ":" and (kind == "q" or frame.kind == "object" and kind in ")]},") or kind == "{" and before == "k" and word in ("interface", "enum", "namespace")):
            raise fault(i)
        if language == "c" and kind == "," and before in "(," and frame.mark == "(" and frame.statement.islower():
            raise fault(i)
        if kind == "," or kind == ")" or kind == "]":
            if before == "," and (kind == "," and (frame.mark == "(" or not script)) and language != "c":
                raise fault(i)
        if kind in "([{":
            stack.append(frame)
            what = "group"
            if kind == "(":
                what = "for" if word == "for" and before == "B" or word == "await" and word2 == "for" else "control" if word in ("if", "while", "switch", "catch", "with") and before in "PBk" else "call"
            elif kind == "[":
                what = "index"
            elif opened:
                what, opened = opened, ""
            elif before in "oqy,([?:<" or before == "k" and word in ("return", "default", "case", "typeof", "yield", "await", "in", "of") or before == "B" and word in ("return", "throw", "default"):
                what = "block" if word == "=>" or before == ":" and frame.kind == "block" and not frame.questions else "object"
            else:
                what = "block"
            if language == "rust" and (word in ("!", "#") or word2 == "!" and before == "w" and kind == "{" or frame.kind == "macro"):
                what = "macro"
            elif language == "c" and kind == "{":
                what = "list" if before in "q,({)" and (before != ")" or frame.kind == "list" or frame.mark == "(") or frame.statement == "enum" else "block"
                if before == "{" and frame.kind == "block":
                    what = "block"
            frame = _Frame(kind, what)
            if kind == "(":
                frame.statement = word
        elif kind in ")]}":
            if frame.kind == "for" and script and (frame.semicolons not in (0, 2) or not frame.semicolons and not frame.infix):
                raise fault(i)
            if kind == "}" and language in ("c", "java") and frame.kind == "block" and before in "wunsk" and frame.semicolons and not word.isupper():
                raise fault(i)
            if kind == "}" and language == "c" and frame.kind == "block" and before in "ns" and frame.statement == "return":
                raise fault(i)
            closed = frame.kind
            frame = stack.pop() if stack else frame
            if kind == "}" and frame.mark == "" or kind == "}":
                frame.statement = frame.statement if frame.statement == "case" else ""
            before2, before, word2, word, line, line2 = before, kind, word, closed, False, line
            continue
        elif kind == ";":
            frame.semicolons += 1
            frame.statement = ""
            opened = "" if language != "c" else opened
            if frame.mark == "(" and frame.kind != "for" and language not in ("rust", "go", "c") and frame.kind != "macro" and not (language == "java" and frame.kind in ("call", "control")):
                raise fault(i)
        elif token == "?":
            frame.questions += 1
        elif kind == ":":
            if frame.cases:
                frame.cases -= 1
            elif frame.questions:
                frame.questions -= 1
            elif plain and (frame.mark == "(" or frame.mark == "[" or frame.kind == "class" or before == ")" or before == "V" or before2 == "V"):
                raise fault(i)
        elif kind == "P" or token == "case" or token == "default":
            if token == "case" or token == "default" and (before in ";{}:" or line):
                frame.cases = 1
        if wordy:
            if not frame.statement or before in ";{}":
                frame.statement = token
            if kind != "w":
                if token == "class" or script and token in ("interface", "namespace", "module", "enum"):
                    opened = "class" if token == "class" else "type" if script else ""
                elif token in ("in", "of") and frame.kind == "for":
                    frame.infix = True
                elif token == "enum":
                    frame.statement = "enum"
            if kind == "F" and script:
                following = [t for t in tokens[i + 1 : i + 5] if t != "\n"][:2]
                if len(following) == 2 and known[following[0]] in "wu" and following[1] not in ("(", "<"):
                    raise fault(i + 1)
            elif kind == "I" and script and before != "m":
                following = tokens[i + 1 : i + 4]
                if len(following) >= 2 and known[following[0]] in "wu" and (following[1] in ("\n", ";") or known[following[1]] in "mo" or plain and following[1] == "="):
                    raise fault(i + 1)
            elif language == "c" and kind == "w" and frame.mark == "(" and frame.kind == "call" and before == "w" and word2 in ("int", "char", "short", "long", "float", "double") and not line and not line2 and i + 1 < count and tokens[i + 1] in (",", ")"):
                raise fault(i)
        if script and token == "*" and kind in "oy":
            kind = "o" if before in "wuns)]" else "x"
        if plain and kind == ":" and frame.kind == "class":
            raise fault(i)
        before2, before, word2, word, line, line2 = before, kind, word, token, False, line
    if before in "oqm":
        raise Fault("premature end: " + " ".join(tokens[-3:])[-40:])


# Words of JavaScript and of TypeScript after which another word may stand on the line.
_SOFT = {"javascript": set("async get set static of as from accessor using await new typeof void delete yield in instanceof extends export default return throw case const let var class function import else do".split())}
_SOFT["typescript"] = _SOFT["javascript"] | set("type declare abstract readonly public private protected override namespace module keyof is infer satisfies asserts unique global out interface enum implements".split())


def _top_level(shape: str) -> list[str]:
    """The statements outside all braces, without what is in the braces."""
    flat, depth, start, out = [], 0, 0, []
    for m in re.finditer(r"[{}]", shape):
        if m[0] == "{":
            if not depth:
                out.append(shape[start : m.start()])
            depth += 1
        else:
            depth -= 1
            if not depth:
                start = m.end()
                out.append("{}")
    out.append(shape[start:])
    flat = "".join(out)
    return flat.split("\n")


def _braces(language: str, text: str) -> None:
    text = text.removeprefix("\ufeff")
    if text.startswith("#!") and language in ("javascript", "typescript"):
        text = "//" + text[2:]  # how the file is to be run
    try:
        shape = skeleton(language, text)
    except Fault:
        if language != "c" or "#" not in text:
            raise
        shape = skeleton(language, _first_branches(text))
    if CONFLICT.search(shape):
        raise Fault("merge conflict")
    if language == "c":
        shape = _preprocessed(shape)
    _automaton(language, shape)
    stripped = shape.strip()
    if language == "go":
        head = re.match(r"\s*package[ \t]+[A-Za-z_]\w*[ \t]*(?:;|\r?\n|\Z)", shape)
        if head is None:
            raise Fault("no package clause")
        _only(shape[head.end() :], r"(?:import|func|type|var|const)\b")
    elif language == "rust":
        _only(re.sub(r"#!?\[(?:[^\[\]]|\[[^\]]*\])*\]", " ", shape), r"(?:(?:use|mod|fn|pub|struct|enum|union|impl|trait|const|static|type|extern|unsafe|async|macro_rules|default|auto)\b|\w[\w:]*!|#)", whole=False)
        if re.search(r"^[ \t]*(?:function|def|class|import|package|func|public|private)\b[ \t]+[\w.*{]+", shape, re.M):
            raise Fault("another language")
    elif language == "java":
        if stripped:
            _only(re.sub(r"@[\w.]+(?:\([^()]*\))?", " ", shape), r"(?:import|package|public|protected|private|abstract|final|static|strictfp|sealed|non-sealed|class|interface|enum|record|module|open)\b", whole=False)
            if re.search(r"^[ \t]*(?:func|fn|def|function|let|const|export|use|impl)[ \t]+\w", shape, re.M):
                raise Fault("another language")
    elif language == "c":
        if re.search(r"^[ \t]*(?:function|class|import|export|package|func|fn|def|public|private|protected|let|var|use|impl|pub|namespace|using|interface|from|throw|try)\b(?=[ \t]+[\w\"<{*]|[ \t]*:?[ \t]*\r?$)(?![ \t]*\r?\n?[ \t]*[=;,)(\[*])", shape, re.M):
            raise Fault("another language")
        for line in _top_level(shape):
            if re.match(r"\s*(?:if|for|while|return|switch|else|do|case|break)\b", line):
                raise Fault("statement outside a function")
        if re.search(r"\w[ \t]*:[ \t]*\r?$", shape, re.M) and re.search(r"^(?!\s*(?:case\b|default\b))[ \t]*[A-Za-z_]\w*[^?\n]*[\w\"\])][ \t]*:[ \t]*[\w\"\[]", shape, re.M) and ";" not in shape:
            raise Fault("another language")
        if ";" not in shape and "}" not in shape and re.search(r"\w", re.sub(r"\b[A-Z_]\w*(?:\s*\([^()]*\))?", "", shape)):
            raise Fault("no declaration")
    else:
        _script(shape)


def _script(shape: str) -> None:
    if not re.search(r"[;{}()]", shape) and re.search(r"^[ \t]*[\w$]+:[ \t]*\r?\n[ \t]+[\w$]+:[ \t]*\S", shape, re.M):
        raise Fault("another language")
    if shape.lstrip().startswith(("[", "-")) and re.search(r"^\[[\w.\-\"]+\][ \t]*\r?\n[\w-]+[ \t]*=|^[ \t]*-[ \t]+\w+:", shape, re.M):
        raise Fault("another language")


def _only(shape: str, start: str, whole: bool = True) -> None:
    """Each statement outside braces begins as it may."""
    begins = re.compile(rf"\s*(?:{start}|\Z)")
    depth, low, pieces = 0, 0, []
    for m in re.finditer(r"[(){}\[\];]" if not whole else r"[(){}\[\];]|\n", shape):
        mark = m[0]
        if mark in "({[":
            depth += 1
        elif mark in ")}]":
            depth -= 1
            if not depth and mark == "}":
                rest = re.match(r"[ \t]*(?:[=.,;(\[)|&+*/<>:?-]|\s*else\b|$)?", shape[m.end() : m.end() + 80])
                if not (rest and rest[0].strip()):
                    pieces.append(shape[low : m.start()])
                    low = m.end()
        elif not depth:
            pieces.append(shape[low : m.start()])
            low = m.end()
    last = shape[low:]
    for piece in pieces:
        if not begins.match(piece):
            raise Fault(f"not a declaration: {piece.strip()[:40]!r}")
    if last.strip():
        if not begins.match(last):
            raise Fault(f"not a declaration: {last.strip()[:40]!r}")
        if not whole:
            raise Fault("premature end of a declaration")


def _first_branches(text: str) -> str:
    """Without the lines between #else or #elif and #endif: each branch may open the same bracket."""
    out, open_, skip = [], [], 0
    for line in text.split("\n"):
        m = re.match(r"\s*#\s*(if|ifdef|ifndef|elif|else|endif)\b", line)
        if m:
            if m[1].startswith("if"):
                open_.append(False)
            elif open_ and m[1] == "endif":
                skip -= open_.pop()
            elif open_ and not open_[-1]:
                open_[-1] = True
                skip += 1
        elif skip:
            continue
        out.append(line)
    return "\n".join(out)


def _preprocessed(shape: str) -> str:
    """Without directives; raises where conditionals do not nest."""
    depth, out = 0, []
    lines = re.sub(r"\\\r?\n", " ", shape).split("\n")
    for line in lines:
        mark = line.lstrip()
        if mark.startswith("#"):
            word = re.match(r"#\s*(\w*)", mark)[1]
            if word in ("if", "ifdef", "ifndef"):
                depth += 1
            elif word in ("endif", "else", "elif"):
                if not depth:
                    raise Fault(f"unbalanced #{word}")
                depth -= word == "endif"
            elif word == "include" and not re.match(r"#\s*include\s*(?:<[^>\n]+>|\"\"|[A-Z_])", mark):
                raise Fault("include without a name")
            elif word and word not in ("include", "define", "undef", "error", "warning", "pragma", "line", "embed", "elifdef", "elifndef"):
                raise Fault(f"unknown directive #{word}")
            elif not word and mark.rstrip() != "#":
                raise Fault("unknown directive")
            line = ""
        out.append(line)
    if depth:
        raise Fault("premature end: #if is open")
    return "\n".join(out)


# --- Python ----------------------------------------------------------------------------------------------------------

_PY_STRING = r"\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?!'')(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_PY = re.compile(rf"[^#\"'()\[\]{{}}\n\\]*(?:(?P<c>#[^\n]*)|(?P<s>{_PY_STRING})|(?P<b>[()\[\]{{}}])|(?P<u>[\"'])|(?P<n>\n)|(?P<j>\\\r?\n)|(?P<o>\\))")
_PY_NESTED = re.compile(_PY_STRING)
_FORMATTED = re.compile(r"(?:^|[^\w])(?:[fFtT][rR]?|[rR][fFtT])$")
_PREFIX = re.compile(r"(?:^|(?<=[^\w]))(?:[rR]?[bBfFtT]|[bBfFtT][rR]|[rRuU])$")
# The words of Python.
_PY_WORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY_OPENERS = set("if elif else for while try except finally with def class match case".split())
_PY_TOKEN = re.compile(r"[^\W\d]\w*|0[xX]\w*|(?:\d\w*(?:\.(?:\d\w*|[eE][+-]?\d\w*|[jJ]\b)?)?|\.\d\w*)(?:(?<=[eE])[+-]\d\w*)?|\"\"|\.\.\.|\*\*=?|//=?|<<=?|>>=?|->|:=|[=!<>+\-*/%&|^@]=|[^\s\w]")
_PY_NUMBER = re.compile(r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|\d(?:_?\d)*\.(?:\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)$")
_PY_BINARY = set("/ // % @ & | ^ << >> < > <= >= == != and or in is **".split())
_PY_ASSIGN = set("= += -= *= /= //= %= @= &= |= ^= <<= >>= **=".split())
#: Which statement a block may follow at its indentation.
_PY_FOLLOWS = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "else of try")}


def _formatted_end(text: str, at: int) -> int:
    """Where the f-string ends whose first quote is at `at`; -1 if it does not."""
    mark = text[at : at + 3] if text[at : at + 3] in ('"""', "\'\'\'") else text[at]
    depth, i, n = 0, at + len(mark), len(text)
    while i < n:
        c = text[i]
        if not depth:
            if text.startswith(mark, i):
                return i + len(mark)
            if c == "\\":
                i += 1
            elif c == "{":
                if text.startswith("{{", i):
                    i += 1
                else:
                    depth = 1
            elif c == "\n" and len(mark) == 1:
                return -1
        elif c in "\"'":
            nested = _PY_NESTED.match(text, i)
            if not nested:
                return -1
            i = nested.end()
            continue
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        i += 1
    return -1


def _python_lines(text: str) -> list[str]:
    """The logical lines: comments left out, literals as `""`, line ends in brackets as blanks."""
    lines, out, stack, at = [], [], [], 0
    text = text.removeprefix("\ufeff")
    while m := _PY.match(text, at):
        kind = m.lastgroup
        out.append(text[at : m.start(kind)])
        at = m.end()
        if kind == "n":
            if stack:
                out.append(" ")
            else:
                lines.append("".join(out))
                out = []
        elif kind == "b":
            mark = m["b"]
            out.append(mark)
            if mark in "([{":
                stack.append(mark)
            elif not stack or stack.pop() != PAIR[mark]:
                raise Fault(f"unbalanced {mark}")
        elif kind == "s" or kind == "u":
            before = out[-1][-3:]
            if _FORMATTED.search(before):
                at = _formatted_end(text, m.start(kind))
                if at < 0:
                    raise Fault("unterminated literal")
            elif kind == "u":
                raise Fault("unterminated literal")
            prefix = _PREFIX.search(before)
            if prefix:
                out[-1] = out[-1][: -len(prefix[0])] if prefix[0] else out[-1]
            out.append('""')
        elif kind == "j":
            out.append(" ")
        elif kind == "o":
            raise Fault("stray backslash")
    if stack:
        raise Fault(f"premature end: {stack[-1]} is open")
    lines.append("".join([*out, text[at:]]))
    return lines


def _python(text: str) -> None:
    if "\x00" in text:
        raise Fault("null character")
    indents, expect = [""], False
    blocks = [""]  # what the last statement of each open indentation was
    try_blocks = [False]
    for line in _python_lines(text):
        body = line.strip(" \t\r\f")
        if not body:
            continue
        if CONFLICT.match(line):
            raise Fault("merge conflict")
        indent = line[: len(line) - len(line.lstrip(" \t\f"))].replace("\f", "")
        if expect:
            if not (len(indent) > len(indents[-1]) and indent.startswith(indents[-1])):
                raise Fault("no indented block")
            indents.append(indent)
            blocks.append("")
            try_blocks.append(False)
        else:
            while len(indent) < len(indents[-1]):
                if blocks[-1] == "try":
                    raise Fault("try without except")
                indents.pop()
                blocks.pop()
                try_blocks.pop()
            if indent != indents[-1]:
                raise Fault("indentation")
        first, expect = _python_statement(body)
        before = blocks[-1]
        if first in _PY_FOLLOWS:
            if before not in _PY_FOLLOWS[first]:
                raise Fault(f"misplaced {first}")
            if first == "else" and before == "except":
                first = "else of try"
        elif before == "try":
            raise Fault("try without except")
        blocks[-1] = first
    if expect:
        raise Fault("premature end: a block is missing")
    if "try" in blocks:
        raise Fault("try without except")


def _python_statement(body: str) -> tuple[str, bool]:
    """The first word of a logical line, and whether an indented block must follow; raises where its tokens do not fit."""
    tokens = _PY_TOKEN.findall(body)
    first = tokens[0]
    head = tokens[1] if first == "async" and len(tokens) > 1 else first
    if first == "async" and head not in ("def", "for", "with"):
        raise Fault("misplaced async")
    if head in ("match", "case") and not (tokens[-1] == ":" or ":" in tokens) or head in ("match", "case") and len(tokens) > 1 and (tokens[1] in _PY_ASSIGN or tokens[1] in ".:,)" or tokens[1] in _PY_BINARY):
        head = ""
    if head in ("match", "case") and len(tokens) > 1 and tokens[1] in ("(", "[", "-", "*") and tokens[-1] != ":" and not (head == "case" and ":" in tokens):
        head = ""
    if head not in _PY_OPENERS:
        _python_simple(tokens, 0)
        return first, False
    start = 2 if first == "async" else 1
    end = _python_header(head, tokens, start)
    if end < len(tokens):
        _python_simple(tokens, end)
        return head, False
    return head, True


def _python_header(head: str, tokens: list[str], start: int) -> int:
    """Reads the header of a compound statement; gives the place after its colon."""
    n = len(tokens)
    if head in ("else", "try", "finally"):
        if start >= n or tokens[start] != ":":
            raise Fault(f"no colon after {head}")
        return start + 1
    if head in ("def", "class"):
        if start >= n or not _is_name(tokens[start]):
            raise Fault(f"no name after {head}")
        after = tokens[start + 1] if start + 1 < n else ""
        if after not in (("(", "[") if head == "def" else ("(", "[", ":")):
            raise Fault(f"misplaced {after!r}")
        return _python_expression(tokens, start, head)
    if head == "except" and start < n and tokens[start] == "*":
        start += 1
    if head == "except" and start < n and tokens[start] == ":":
        return start + 1
    return _python_expression(tokens, start, head)


def _is_name(token: str) -> bool:
    return (token[0].isalpha() or token[0] == "_" or token[0] > "\x7f") and token.isidentifier() and token not in _PY_WORDS


def _python_simple(tokens: list[str], start: int) -> None:
    """Simple statements between semicolons."""
    n, at = len(tokens), start
    while at < n:
        word = tokens[at]
        if word in ("pass", "break", "continue"):
            at += 1
            if at < n and tokens[at] != ";":
                raise Fault(f"misplaced {tokens[at]}")
        elif word in ("global", "nonlocal"):
            want = True
            at += 1
            while at < n and tokens[at] != ";":
                if want != _is_name(tokens[at]) or not want and tokens[at] != ",":
                    raise Fault(f"misplaced {tokens[at]}")
                want = not want
                at += 1
            if want:
                raise Fault("premature end of a statement")
        elif word in ("import", "from"):
            at = _python_import(tokens, at)
        elif word in _PY_OPENERS - {"match", "case"} or word in ("elif", "as", "in", "is", "and", "or"):
            raise Fault(f"misplaced {word}")
        else:
            empty = word == "return" or word == "raise"
            if word in ("return", "raise", "del", "assert"):
                at += 1
            elif word == "type" and at + 2 < n and _is_name(tokens[at + 1]) and tokens[at + 2] in ("=", "["):
                at += 1
            if empty and (at >= n or tokens[at] == ";"):
                pass
            else:
                at = _python_expression(tokens, at, word if word in ("return", "raise", "del", "assert") else "")
        if at < n:
            if tokens[at] != ";":
                raise Fault(f"misplaced {tokens[at]}")
            at += 1
            if at < n and tokens[at] == ";":
                raise Fault("misplaced ;")


def _python_import(tokens: list[str], at: int) -> int:
    n, start = len(tokens), at

    def dotted(i: int) -> int:
        if i >= n or not _is_name(tokens[i]):
            raise Fault("no module")
        while i + 1 < n and tokens[i + 1] == ".":
            i += 2
            if i >= n or not _is_name(tokens[i]):
                raise Fault("no module")
        return i + 1

    def named(i: int) -> int:
        if i < n and tokens[i] == "as":
            if i + 1 >= n or not _is_name(tokens[i + 1]):
                raise Fault("no name after as")
            return i + 2
        return i

    at += 1
    if tokens[start] == "from":
        dots = at
        while at < n and tokens[at] in (".", "..."):
            at += 1
        if at == dots or at < n and tokens[at] != "import":
            at = dotted(at)
        if at >= n or tokens[at] != "import":
            raise Fault("from without import")
        at += 1
        if at < n and tokens[at] == "*":
            return at + 1
        closed = at < n and tokens[at] == "("
        at += closed
        while True:
            if at >= n or not _is_name(tokens[at]):
                raise Fault("no name to import")
            at = named(at + 1)
            if at < n and tokens[at] == ",":
                at += 1
                if closed and at < n and tokens[at] == ")":
                    return at + 1
                continue
            if closed:
                if at >= n or tokens[at] != ")":
                    raise Fault("misplaced token in import")
                at += 1
            return at
    while True:
        at = named(dotted(at))
        if at < n and tokens[at] == ",":
            at += 1
            continue
        return at


def _python_expression(tokens: list[str], at: int, statement: str) -> int:
    """The pushdown automaton of expressions: wants or has an operand, with a stack of open brackets and lambdas.

    Ends at a semicolon, at the colon of a header, or with the tokens; gives the place where it ended.
    """
    header = statement in _PY_OPENERS
    stack: list[list] = []  # mark, what stood before, open conditions, last before = in it
    want, before, annotated, conditions, loops, n = True, "", False, 0, 0, len(tokens)
    target = True  # whether what was read may be assigned to
    while at < n:
        token = tokens[at]
        at += 1
        top = stack[-1][0] if stack else ""
        if token == '""':
            if not want and before != '""':
                raise Fault("misplaced literal")
            want, target = False, False
        elif token[0].isdigit() or token[0] == "." and token[1:2].isdigit():
            if not want or not _PY_NUMBER.match(token):
                raise Fault(f"misplaced {token}")
            want, target = False, False
        elif token in ("True", "False", "None", "..."):
            if not want:
                raise Fault(f"misplaced {token}")
            want, target = False, token == "..." and top != ""
            if before == ".":
                raise Fault(f"misplaced {token}")
        elif token in ("not", "lambda", "await", "yield"):
            if token == "not" and not want:
                if at >= n or tokens[at] != "in":
                    raise Fault("misplaced not")
                at += 1
                want, token = True, "in"
            elif not want or before == ".":
                raise Fault(f"misplaced {token}")
            elif token == "lambda":
                stack.append(["lambda", before, conditions])
                conditions = 0
                before = "("
                continue
            elif token == "yield":
                if at < n and tokens[at] == "from":
                    at += 1
                elif at >= n or tokens[at] in (")", "]", "}", ";", "=") or tokens[at] == ",":
                    want, target = False, False
            target = False
        elif token in ("and", "or", "is", "in", "if", "else", "for", "async", "as", "from"):
            if want and not (token in ("for", "if", "async") and before == ","):
                raise Fault(f"misplaced {token}")
            if want:
                raise Fault(f"misplaced {token}")
            if token == "if":
                conditions += 1
            elif token == "else":
                if not conditions:
                    raise Fault("misplaced else")
                conditions -= 1
            elif token == "for":
                if top not in ("(", "[", "{") and statement != "for":
                    raise Fault("misplaced for")
                conditions = 0  # what follows may have conditions without else
                loops += 1
            elif token == "async":
                if at >= n or tokens[at] != "for":
                    raise Fault("misplaced async")
                continue
            elif token == "as":
                if not (statement in ("with", "except", "case")) or top not in ("", "(", "[", "{"):
                    raise Fault("misplaced as")
            elif token == "from" and statement != "raise":
                raise Fault("misplaced from")
            elif token == "is" and at < n and tokens[at] == "not":
                at += 1
            want, target = True, token == "as" or token == "for"
        elif token[0].isalpha() or token[0] == "_" or token[0] > "\x7f":
            if not token.isidentifier():
                raise Fault(f"stray {token}")
            if token in _PY_WORDS or not want:
                raise Fault(f"misplaced {token}")
            want, target = False, True
        elif token in "([{" and len(token) == 1:
            if not want and token == "{":
                raise Fault("misplaced {")
            if token == "(" and want and top == "(" and statement == "def" and len(stack) == 1 and before in ("(", ","):
                raise Fault("misplaced (")
            stack.append([token, "call" if not want else "", conditions])
            conditions, want, before, target = 0, True, token, True
            continue
        elif token in (")", "]", "}"):
            if stack and stack[-1][0] == "lambda":
                raise Fault("lambda without colon")
            if not stack:
                raise Fault(f"unbalanced {token}")
            mark, role, outer = stack.pop()
            if want and before not in (mark, ",") and not (mark == "[" and before == ":"):
                raise Fault(f"misplaced {token}")
            if want and before == mark and mark == "[" and role == "call":
                raise Fault("empty index")
            conditions, want = outer, False
            target = (target or before == mark or before == ",") if role != "call" else mark == "["
            if mark == "{":
                target = False
            before = token
            continue
        elif token == ",":
            if want and not (before == ":" and top == "["):
                raise Fault("misplaced ,")
            if top == "" and (statement == "except" and "as" in tokens[at:] or statement == "raise" or statement == "except"):
                raise Fault("misplaced ,")
            want = True
        elif token == ":":
            if top == "lambda":
                if want and before not in ("(", ",", "*"):
                    raise Fault("misplaced :")
                _, _, conditions = stack.pop()
                want, before, target = True, "lambda:", False
                continue
            if not top:
                if header:
                    if want and before != ",":
                        raise Fault("misplaced :")
                    if statement == "for" and not loops and "in" not in tokens:
                        raise Fault("for without in")
                    return at
                if want or annotated or statement or not target:
                    raise Fault("misplaced :")
                annotated = True
                want, before = True, token
                continue
            if want and not (top == "[" and before in ("[", ":", ",")) or top == "(" and statement != "def":
                raise Fault("misplaced :")
            want = True
        elif token == ".":
            if want or at >= n or not (tokens[at][0].isalpha() or tokens[at][0] == "_" or tokens[at][0] > "\x7f") or tokens[at] in _PY_WORDS:
                raise Fault("misplaced .")
            at += 1
            target, token = True, "member"
        elif token == "->":
            if statement != "def" or top or want or before != ")":
                raise Fault("misplaced ->")
            want = True
        elif token in _PY_ASSIGN:
            if top == "lambda" and token == "=" or top == "(" and token == "=" or top == "[" and token == "=" and statement in ("def", "class", "") and before != "[":
                if want:
                    raise Fault("misplaced =")
            elif top or header or want and before != "," or statement in ("return", "raise", "del", "assert") or not target and not annotated or conditions:
                raise Fault(f"misplaced {token}")
            want = True
        elif token == ":=":
            if want or not target:
                raise Fault("misplaced :=")
            want = True
        elif token in ("*", "**"):
            if want and before not in ("(", "[", "{", ",", "", "=", ":", "in", "lambda", "return", "yield", "case", "for", "del") :
                raise Fault(f"misplaced {token}")
            if want and (token == "*" and at < n and tokens[at] in (",", ":") or tokens[at : at + 1] == [")"]) and (statement == "def" or top == "lambda"):
                want = False  # a bare star between parameters
            elif not want:
                want = True
        elif token in ("+", "-"):
            want = True
        elif token == "~":
            if not want:
                raise Fault("misplaced ~")
        elif token == "@" and want and before == "" and not statement:
            pass  # a decorator
        elif token == "/" and want and before == "," and (statement == "def" or top == "lambda"):
            want = False
        elif token in _PY_BINARY:
            if want:
                raise Fault(f"misplaced {token}")
            want, target = True, False
        elif token == ";":
            if top or want and before != ",":
                raise Fault("misplaced ;")
            return at - 1
        else:
            raise Fault(f"stray {token}")
        if token in ("+", "-", "*", "/"):
            target = token == "*" and before in ("", "(", "[", ",")
        before = token
    if stack:
        raise Fault("lambda without colon")
    if header:
        raise Fault("no colon at the end")
    if want and before != ",":
        raise Fault("premature end of a statement")
    if want and statement in ("raise", "assert"):
        raise Fault("premature end of a statement")
    if conditions and not loops:
        raise Fault("if without else")
    return at


# --- settings --------------------------------------------------------------------------------------------------------

_JSON = re.compile(r"[ \t\r\n]*(?:(?P<s>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<v>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b)|(?P<b>[\[\]{},:]))")


def _json(text: str) -> None:
    """A stack of open containers; in each of them a state says what may come."""
    stack: list[str] = []
    state, at = "value", 0  # value, key, first key, first value, colon, after, end
    end = len(text.rstrip(" \t\r\n"))
    while at < end:
        m = _JSON.match(text, at)
        if m is None:
            raise Fault("no JSON token")
        at, kind, mark = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "b" and mark in "{[" and state in ("value", "first value"):
            stack.append(mark)
            state = "first key" if mark == "{" else "first value"
        elif kind == "b" and mark in "}]" and stack and stack[-1] == PAIR[mark] and state in ("after", "first key", "first value"):
            stack.pop()
            state = "after" if stack else "end"
        elif mark == "," and state == "after":
            state = "key" if stack[-1] == "{" else "value"
        elif mark == ":" and state == "colon":
            state = "value"
        elif kind == "s" and state in ("key", "first key"):
            state = "colon"
        elif kind in "sv" and state in ("value", "first value"):
            state = "after" if stack else "end"
        else:
            raise Fault(f"misplaced {mark[:20]!r}")
    if state != "end":
        raise Fault("premature end")

_TOML = re.compile(r"(?P<w>[ \t]+)|(?P<c>#[^\n]*)|(?P<n>\r?\n)|(?P<m>\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"{3,5}|'''(?:[^']|'(?!''))*'{3,5})|(?P<s>\"(?!\"\")(?:[^\"\\\n]|\\[^\n])*\"|'(?!'')[^'\n]*')|(?P<k>[A-Za-z0-9_+-]+(?:[.:][A-Za-z0-9_+:-]+)*(?:[ ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)?)|(?P<b>\[\[|\]\]|[\[\]{},=.])|(?P<u>[\s\S])")
_TOML_VALUE = re.compile(r"(?:true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[\da-fA-F](?:_?[\da-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?)$")
_TOML_KEY = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*$")
_TOML_ESCAPE = re.compile(r"\\(?![btnfre\"\\\s]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8})")


def _toml(text: str) -> None:
    """A stack of open tables' headers, arrays and inline tables, and a state that says what may come."""
    stack: list[str] = []
    state, key, seen, tables, header, path = "line", "", set(), set(), "", ""
    # line, key (more of a key, or what ends it), name (a part of a key must come), value, after (a value), end (of the line)
    for m in _TOML.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind == "w":
            continue
        top = stack[-1] if stack else ""
        if kind == "c" or kind == "n":
            if state in ("line", "end") and not stack:
                state = "line" if kind == "n" else state
            elif top != "[":
                raise Fault("premature end of a line")
            continue
        if kind == "u":
            raise Fault("unterminated literal" if token in "\"'" else f"stray {token}")
        if kind in "sm" and token[0] == '"' and _TOML_ESCAPE.search(token):
            raise Fault("unknown escape")
        if state in ("line", "name", "first") and (kind == "s" or kind == "k" and _TOML_KEY.match(token)):
            path = path + "." + token if state == "name" and key else token
            key, state = token, "key"
        elif state == "line" and token in ("[", "[["):
            stack, state, header, key, path = [token], "name", token, "", ""
        elif state == "key" and token == ".":
            state = "name"
        elif state == "key" and header and token == ("]]" if header == "[[" else "]"):
            if header == "[":
                if path in tables:
                    raise Fault(f"second table {path}")
                tables.add(path)
            stack, state, header, seen = [], "end", "", set()
        elif state == "key" and not header and token == "=":
            if not stack:
                if path in seen:
                    raise Fault(f"second key {path}")
                seen.add(path)
            state, key = "value", ""
        elif state in ("value", "item") and (kind in "sm" or kind == "k" and _TOML_VALUE.match(token)):
            state = "after" if stack else "end"
        elif state in ("value", "item") and token in ("[", "[["):
            stack += list(token)
            state = "item"
        elif state in ("value", "item") and token == "{":
            stack.append("{")
            state, key = "first", ""
        elif token in ("]", "]]") and state in ("item", "after") and stack[-len(token) :] == ["["] * len(token):
            del stack[-len(token) :]
            state = "after" if stack else "end"
        elif token == "}" and state in ("first", "after", "name") and top == "{":
            stack.pop()
            state = "after" if stack else "end"
        elif token == "," and state == "after":
            state, key = ("item" if top == "[" else "name"), ""
        else:
            raise Fault(f"misplaced {token[:20]}")
    if stack or state not in ("line", "end"):
        raise Fault("premature end")


_YAML_QUOTED = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'")
_YAML_KEY = re.compile(r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\n]|'')*'|(?![\[\]{}#&*!|>%@`,\"'])(?:[^\s#:]|:(?=\S)|(?<=\S)#|[ \t](?![ \t]*#))+?|[&*]\S+|\?|<<)[ \t]*:(?=[ \t]|$)")
_YAML_FLOW = re.compile(r"(?P<s>\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*')|(?P<b>[\[\]{}])|(?P<c>(?:^|(?<=\s))#[^\n]*)|(?P<x>[^\[\]{}\"'\n#]+|[\"'#])|(?P<n>\n)")


def _yaml(text: str) -> None:
    text = text.replace("\r\n", "\n").removeprefix("﻿")
    lines = text.split("\n")
    stack: list[tuple[int, str]] = []  # open collections: indentation and kind
    scalar: int | None = None  # indentation above which lines continue a plain scalar
    block: int | None = None  # ... a block scalar
    inside: int | None = None  # indentation of the block's own lines
    waits = False  # a key without a value
    root_done = False
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        body = line.strip(" \t")
        indent = len(line) - len(line.lstrip(" "))
        if block is not None:
            if not body:
                continue
            if indent > block:
                if inside is None:
                    inside = indent
                if indent >= inside:
                    continue
                if not body.startswith("#"):
                    raise Fault("indentation in a block")
            block = None
        if not body or body.startswith("#"):
            continue
        if CONFLICT.match(line) and not (scalar is not None and indent > scalar):
            raise Fault("merge conflict")
        if line.startswith(("---", "...")) and (len(line.rstrip()) == 3 or line[3] in " \t"):
            if line.startswith("...") and line.rstrip() != "...":
                raise Fault("content after the end of a document")
            stack, scalar, waits, root_done = [], None, False, False
            body = line[3:].strip()
            if not body:
                continue
        if line.startswith("%"):
            if stack or root_done:
                raise Fault("directive inside a document")
            continue
        if line[indent : indent + 1] == "\t" and (scalar is None or indent <= scalar):
            raise Fault("tab as indentation")
        if scalar is not None:
            if indent > scalar:
                if re.search(r"(?<=\S):(?:[ \t]|$)", re.sub(r"[ \t]#.*", "", body)):
                    raise Fault("mapping inside a plain value")
                continue
            if scalar < 0:
                raise Fault("mapping after a plain document")
            scalar = None
        while stack and indent < stack[-1][0]:
            stack.pop()
        at, fresh = indent, True
        while True:  # the collections that begin on this line
            rest = line[at:].strip(" \t") if fresh and at == indent and not line.startswith("---") else body
            if rest == "-" or rest.startswith(("- ", "-\t")):
                top = stack[-1] if stack else None
                if top and top[0] == at and top[1] == "seq":
                    pass
                elif top and top[0] == at and top[1] == "map":
                    if not waits:
                        raise Fault("list item among keys")
                    stack.append((at, "seq"))
                elif top and top[0] < at and fresh and not waits:
                    raise Fault("indentation")
                elif root_done and not stack:
                    raise Fault("second root")
                else:
                    stack.append((at, "seq"))
                waits, root_done = True, True
                inner = rest[1:].lstrip(" \t")
                if not inner or inner.startswith("#"):
                    body = ""
                    break
                at += len(rest) - len(inner)
                body, fresh = inner, False
                continue
            if rest == "?" or rest.startswith(("? ", "?\t")):  # a key that is a node of its own
                while stack and stack[-1] == (at, "seq"):
                    stack.pop()
                if not (stack and stack[-1] == (at, "map")):
                    if fresh and (stack and not waits or not stack and root_done):
                        raise Fault("indentation")
                    stack.append((at, "map"))
                waits, root_done = True, True
                inner = rest[1:].lstrip(" \t")
                if not inner or inner.startswith("#"):
                    body = ""
                    break
                at += len(rest) - len(inner)
                body, fresh = inner, False
                continue
            key = _YAML_KEY.match(rest)
            if not key and fresh and stack and stack[-1] == (at, "map"):
                key = re.match(r":(?=[ \t]|$)", rest)
            if key:
                while stack and stack[-1] == (at, "seq"):
                    stack.pop()
                top = stack[-1] if stack else None
                if top and top == (at, "map"):
                    pass
                elif fresh and top and top[0] < at and not waits:
                    raise Fault("indentation")
                elif fresh and stack and top[0] > at or (not stack and root_done):
                    raise Fault("indentation")
                else:
                    stack.append((at, "map"))
                waits, root_done = True, True
                inner = rest[key.end() :].lstrip(" \t")
                body = "" if inner.startswith("#") else inner
                break
            body = rest
            if fresh:
                top = stack[-1] if stack else None
                if top and (top[0] == at or not waits):
                    raise Fault("value without a key")
                if not stack and root_done:
                    raise Fault("second root")
            break
        root_done = True
        body = re.sub(r"^(?:[&!][^\s]*[ \t]*)+", "", body)
        if not body:
            continue
        waits = False
        owner = stack[-1][0] if stack else -1
        if body[0] in "\"'[{":
            rest = "\n".join([body, *lines[i:]])
            length = _flow_end(rest)
            used = rest.count("\n", 0, length)
            i += used
            tail = rest[length : rest.find("\n", length) if "\n" in rest[length:] else None]
            after = tail.strip()
            if after and not (after.startswith("#") and tail[0] in " \t"):
                raise Fault("content after a value")
        elif body[0] in "|>":
            if not re.match(r"[|>](?:[1-9]?[+-]?|[+-][1-9]?)(?:[ \t]+#.*|[ \t]*)$", body):
                raise Fault("bad block header")
            digit = re.search(r"[1-9]", body[:3])
            block, inside = owner, (max(owner, 0) + int(digit[0]) if digit else None)
        elif body[0] in "@`%":
            raise Fault("reserved mark")
        elif body[0] == "*":
            if not re.match(r"\*[^\s,\[\]{}]+[ \t]*(?:#.*)?$", body):
                raise Fault("content after an alias")
        else:
            plain = re.sub(r"[ \t]#.*", "", body)
            if re.search(r":(?:[ \t]|$)", plain) or re.match(r"[,\]}]|-(?:[ \t]|$)|\?[ \t]", plain):
                raise Fault("mapping inside a plain value")
            scalar = owner
    if CONFLICT.search("\n".join(x for x in lines[-1:] if x)):
        raise Fault("merge conflict")


def _flow_end(text: str) -> int:
    """Where the quoted or bracketed value at the start of the text ends."""
    if text[0] in "\"'":
        m = _YAML_QUOTED.match(text)
        if m is None:
            raise Fault("unterminated literal")
        return m.end()
    stack: list[str] = []
    before = ""
    for m in _YAML_FLOW.finditer(text):
        kind, mark = m.lastgroup, m[0]
        if kind == "b":
            if mark in "[{":
                if before in ("x", "s", "close"):
                    raise Fault("values without a comma")
                stack.append(mark)
                before = ""
            else:
                if not stack or stack.pop() != PAIR[mark]:
                    raise Fault(f"unbalanced {mark}")
                if not stack:
                    return m.end()
                before = "close"
        elif kind == "s":
            if before in ("s", "close"):
                raise Fault("values without a comma")
            before = "s"
        elif kind == "x":
            if mark in "\"'" and before != "x":
                raise Fault("unterminated literal")
            word = mark.strip()
            if not word:
                continue
            if before in ("s", "close") and word[0] not in ",:":
                raise Fault("values without a comma")
            before = "" if word[-1] in ",:" else "x"
            if re.search(r",\s*,", mark):
                raise Fault("empty value")
        elif kind == "n" and CONFLICT.match(text, m.end()):
            raise Fault("merge conflict")
    raise Fault("premature end: a bracket is open")


CHECKS: dict[str, Callable[[str], None]] = {
    "python": _python,
    "json": _json,
    "toml": _toml,
    "yaml": _yaml,
    **{name: (lambda text, name=name: _braces(name, text)) for name in SCAN},
}
#: The language of each extension.
LANGUAGE = {"py": "python", "pyx": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "go": "go", "java": "java", "rs": "rust", "c": "c", "h": "c", "json": "json", "yaml": "yaml", "toml": "toml", "md": "markdown", "txt": "text", "css": "css"}


def problem(language: str | None, content: str | None) -> str | None:
    """What is wrong with the text first; None if nothing is, or if the language has no syntax to break."""
    check = CHECKS.get(language)
    if check is None or content is None:
        return None
    try:
        check(content)
    except Fault as fault:
        return str(fault)
    return None
