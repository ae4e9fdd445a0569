"""Markup residue: flat text blocks, classified by trees over word counts, link densities and signs, and clean text.

Every non-blank line of a text is a block. Its features are its word count and link density and those of the blocks
before and after it, the signs of HTML, Markdown, wiki and LaTeX source in it and beside it, and how much of it and of its
neighbours looks like code. Two decision trees, grown on the labelled texts of markup_table.py, give a block's kind and
whether it holds markup source. Signs that source shares with prose and code (a leading # or -, __name__, a[b](c), x<y>,
backticks) are features of their own, which the tree weighs by the neighbours.

The converter takes line and inline signs and entities away only from blocks that hold source, and leaves indented ones
of kind code as they are; tags and constructs over several lines are taken wherever they stand. It keeps headings and list items on
lines of their own (items begin with a bullet under their indent or with their number), code verbatim, formulas in plain
signs, table cells apart by tabs, and images by their description.

Defined cases: a null text gives null results; an empty or blank text is empty and clean. Texts of any length are read
whole, block by block. Repeated rows are treated alike; other columns stay as they are.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmere.llm.markup_table import texts

KINDS = ("prose", "heading", "list", "code", "formula", "table", "scaffold")
# Element names of HTML and of wiki text.
TAG_NAMES = """a abbr address article aside b big blockquote body br caption center cite code col colgroup dd del details dfn div dl dt em
figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta nav
noscript nowiki ol option p picture pre q ref references s samp script section select small source span strike strong style sub summary
sup svg syntaxhighlight table tbody td template textarea tfoot th thead time title tr tt u ul var video gallery poem"""
TAGS = "|".join(sorted(TAG_NAMES.split(), key=len, reverse=True))
ATTRIBUTE = r"""\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+)"""
TAG = rf"</?(?:{TAGS})(?:{ATTRIBUTE})*\s*/?>"
HEAD_TEX = r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?"
# A command needs a backslash that no path leads up to, and an argument, an optional one or a known name.
# Known commands may follow a word directly.
TEX_NOTE = r"\\(?:cite\w*|ref|eqref|pageref|label|footnote|emph|text(?:bf|it|tt|sc|sf|rm)|underline|url|href)\*?(?:\[[^\]\n]*\])?\{"
TEX_COMMAND = rf"(?<![:\\/]){TEX_NOTE}|(?<![\w:\\/])\\(?:[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{{|(?:item|maketitle|tableofcontents|hline|centering|noindent|newpage|bigskip|medskip|par|TeX|LaTeX|ldots)\b)"
MATH = r"(?<![\w$\\])\$(?=[^\s$])(?=[^$\n]*[\\^_={}+<>]|[A-Za-z]\$)[^$\n]*[^\s$\\]\$(?![\w$])"

#: family and pattern of each sign.
SIGNS = {
    "tag": ("html", re.compile(TAG, re.I)),
    "comment": ("html", re.compile(r"<!--|-->|<!DOCTYPE\b|<\?xml\b|<!\[CDATA\[", re.I)),
    "entity": ("html", re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")),
    "md_heading": ("line", re.compile(r"^ {0,3}#{1,6}[ \t]+\S")),
    "rule": ("line", re.compile(r"^ {0,3}(?:={4,}|-{3,}|\*{3,}|_{3,}|\* \* \*)[ \t]*$")),
    "fence": ("line", re.compile(r"^\s*(?:`{3,}|~{3,})[\w+-]*\s*$")),
    "item": ("item", re.compile(r"^\s*(?:[-*]|\*{2,4})[ \t]+\S")),
    "task": ("line", re.compile(r"^\s*[-*+][ \t]+\[[ xX]\][ \t]")),
    "quote": ("line", re.compile(r"^ {0,3}>{1,3}[ \t]+\S")),
    "table_rule": ("line", re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$(?<=\|)|^\s*\|\s*:?-{3,}")),
    "table_row": ("line", re.compile(r"^\s*\|[^|\n]+\|(?:[^|\n]*\|)*\s*$")),
    "link": ("inline", re.compile(r"!?\[[^\[\]\n]*\]\((?!\s)[^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)")),
    "link_target": ("line", re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S")),
    "footnote": ("inline", re.compile(r"\[\^[\w-]+\]")),
    "strong": ("inline", re.compile(r"(?<![\w*])\*{2,3}(?=[^\s*])[^*\n]*[^\s*]\*{2,3}(?![\w*])|(?<![\w_])_{2,3}(?=[^\W_])[^\n]*?[^\W_]_{2,3}(?![\w_])")),
    "emphasis": ("inline", re.compile(r"(?<![\w*/])\*(?=[^\W_])[^*\n]*[^\W_]\*(?![\w*])|(?<![\w_])_(?=[^\W_])[^_\n]*[^\W_]_(?![\w_])")),
    "strike": ("inline", re.compile(r"~~(?=\S)[^~\n]*\S~~")),
    "tick": ("inline", re.compile(r"(?<!`)`(?=[^`\s])[^`\n]*`(?!`)")),
    "wiki_heading": ("line", re.compile(r"^\s*(={1,6})[ \t]*[^=\s].*?[ \t]*\1[ \t]*$")),
    "wiki_quote": ("inline", re.compile(r"(?<!')'{2,3}(?=[^\s'])[^'\n]*(?:'(?!')[^'\n]*)*[^\s']'{2,3}(?!')|(?<!')'{2,3}(?=[^\s'])\w'{2,3}(?!')")),
    "wiki_link": ("inline", re.compile(r"\[\[[^\[\]\n]+\]\]|\[https?://[^\]\s]+ [^\]\n]+\]")),
    "template": ("inline", re.compile(r"\{\{[^{}\n]+\}\}")),
    "wiki_table": ("line", re.compile(r"^\s*(?:\{\|.*|\|-+.*|\|\}\s*|[|!][^|\n]*(?:\|\||!!).*)$")),
    "command": ("tex", re.compile(TEX_COMMAND)),
    "tex_group": ("tex", re.compile(r"\{\\(?:it|bf|em|tt|sl|sc|rm|sf|small|large|Large)\b")),
    "tex_math": ("tex", re.compile(rf"\$\$|(?<![\w:\\])\\[\[\]()]|{MATH}")),
    "tex_row": ("weak", re.compile(r"&[^&\n]*\\\\\s*$")),
    "tie": ("weak", re.compile(r"[a-z]~[a-z]")),
    "tex_quote": ("weak", re.compile(r"``[^`'\n]+''")),
}
NEEDS = {"tag": "<", "comment": "<>", "entity": "&", "link": "]", "footnote": "[", "strong": "*_", "emphasis": "*_", "strike": "~", "tick": "`", "wiki_quote": "'", "wiki_link": "[", "template": "{", "command": "\\", "tex_group": "{",
         "tex_math": "$\\", "tex_row": "\\", "tie": "~", "tex_quote": "`", "md_heading": "#", "rule": "=-*_", "fence": "`~", "item": "-*", "task": "[", "quote": ">", "table_rule": "-", "table_row": "|", "link_target": "]", "wiki_heading": "=", "wiki_table": "|"}
SPECIAL = re.compile(r"[<>&\[\]{}*#`_=|~\\$'\-]")
CODE_SIGNS = re.compile(r"[;{}()=<>+*\[\]&|]|\bdef\b|\breturn\b|\bassert\b")
WORDS = re.compile(r"\w+")
LINKED = re.compile(r"\[([^\[\]\n]*)\]\([^()\n]*\)|\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]|<a\b[^<>]*>([^<]*)</a>", re.I)
PROSE_WORD = re.compile(r"(?<![\w.])[A-Za-z]{3,}(?=[\s,.;:!?]|$)")
#: Signs that prose and code hold, too.
SHARED = ("hash", "item", "quote", "dunder", "call", "generic", "template_text", "counted", "tie", "tex_quote", "tex_row", "rule")
SHARED_SIGNS = {"item": "item", "quote": "quote", "rule": "rule", "tie": "tie", "tex_quote": "tex_quote", "tex_row": "tex_row"}
# Names that programs put between double underscores.
SPECIAL_NAMES = set("""abs add aenter aexit aiter all and anext annotations array await bases bool builtins bytes call ceil contains deepcopy defaults del
delattr delete delitem dict dir divmod doc enter eq exit file float floor format func ge get getattr getattribute getitem getstate globals
gt hash iadd init instancecheck int invert iter kwdefaults le len lshift lt main metaclass mod mro mul name ne neg new next or pos
post_init pow prepare qualname radd repr reversed round set set_name setattr setitem setstate sizeof slots spec str sub subclasshook
subclasses truediv weakref wrapped xor""".split())
CONTEXT = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "signs_before", "signs_after", "code_share", "code_before", "code_after")
FEATURES = (*CONTEXT, "sure", *SHARED, "number_first", "capital", "prose_words", "stop", "bullet", "tabs", "formula", "head", "list", "table", "code_tag", "math", "indent")
VOID = re.compile(r"<(?:br|hr|img|input|link|meta)\b", re.I)


def signs_of(line: str) -> list[tuple[str, int, int]]:
    """(sign, start, end) of every sign in a block."""
    if not SPECIAL.search(line):
        return []
    out = []
    for name, (_, pattern) in SIGNS.items():
        if any(c in line for c in NEEDS[name]):
            for m in pattern.finditer(line):
                if name == "entity" and m[0][1] != "#" and m[0][1:] not in html5:
                    continue
                out.append((name, m.start(), m.end()))
    return out


def shared_sign(name: str, line: str, start: int, end: int) -> str | None:
    """Which sign that prose and code hold as well this one may be; None where it can only be source."""
    found = line[start:end]
    if name == "md_heading":
        return "hash" if re.match(r"\s*# *[^\W\dA-Z]", found) else None
    if name in SHARED_SIGNS:
        return SHARED_SIGNS[name]
    if name == "strong" and found[:2] == "__" and found.strip("_") in SPECIAL_NAMES:
        return "dunder"
    if name == "link" and start and (line[start - 1].isalnum() or line[start - 1] in "_)]") and found[0] == "[":
        return "call"
    if name == "tag" and start and (line[start - 1].isalnum() or line[start - 1] in "_>") and re.fullmatch(r"<\w+>", found) and not VOID.match(found) and f"</{found[1:-1]}".lower() not in line.lower():
        return "generic"
    if name == "tick" and ("${" in found or re.search(r"[=(+,]\s*$", line[:start]) and re.match(r"\s*[;),+]", line[end:])):
        return "template_text"
    if name == "command" and re.match(r"\\[A-Za-z]\{\d", line[start : end + 1]):
        return "counted"
    return None


def own_features(line: str, signs: list[tuple[str, int, int]]) -> dict[str, float]:
    words = len(WORDS.findall(line))
    linked = sum(len(WORDS.findall(m[1] or m[2] or m[3] or "")) for m in LINKED.finditer(line)) if signs else 0
    f = dict.fromkeys(FEATURES, 0.0)
    f["words"], f["link_density"] = words, linked / max(words, 1)
    names = {s[0] for s in signs}
    kinds = [shared_sign(*found[:1], line, *found[1:]) for found in signs]
    # A shared sign within a sure one is part of it, and so is what a template literal holds.
    spans = [(a, b) for (_, a, b), k in zip(signs, kinds) if k is None]
    literals = [(a, b) for (_, a, b), k in zip(signs, kinds) if k == "template_text"]
    for (_, start, end), kind in zip(signs, kinds):
        if not any(a <= start and end <= b and (a, b) != (start, end) for a, b in (literals if kind is None else spans)):
            f[kind or "sure"] += 1
    stripped = line.strip()
    f["code_share"] = len(CODE_SIGNS.findall(line)) / max(len(stripped), 1)
    f["prose_words"] = len(PROSE_WORD.findall(line))
    first = re.match(r"\W*(.?)", stripped)[1]
    f["number_first"], f["capital"] = float(first.isdigit()), float(first.isupper())
    f["indent"] = float(bool(re.match(r"(?: {4}|\t)\s*\S", line)))
    f["stop"] = float(stripped[-1:] in ".!?:,")
    f["bullet"] = float(stripped[:1] == "•")
    f["tabs"] = line.count("\t")
    f["formula"] = float(bool(re.search(r"[\^=<>/]|_\w", line)) and f["prose_words"] <= 2 and not stripped.endswith(";"))
    f["head"] = float(bool(names & {"md_heading", "wiki_heading"}) or bool(re.match(rf"\s*{HEAD_TEX}\{{|\s*<h[1-6]\b", line, re.I)))
    f["list"] = float(bool(names & {"item", "task"}) or bool(re.match(r"\s*(?:\\item\b|<li\b|\d{1,3}\.[ \t])", line, re.I)))
    f["table"] = float(bool(names & {"table_row", "table_rule", "wiki_table", "tex_row"}) or bool(re.match(r"\s*<(?:table|tr)\b", line, re.I)))
    f["code_tag"] = float(bool(re.search(r"</?(?:pre|code|syntaxhighlight)\b", line, re.I)))
    f["math"] = float("tex_math" in names or "<math" in line)
    return f


def block_features(lines: list[str], signs: list[list[tuple[str, int, int]]] | None = None, only: list[int] | None = None) -> tuple[np.ndarray, list[list[tuple[str, int, int]]]]:
    """Features of the blocks of one text, or of those at the places ``only``, with those of their neighbours, and all signs."""
    signs = signs if signs is not None else [signs_of(x) for x in lines]
    places = range(len(lines)) if only is None else only
    own = {j: own_features(lines[j], signs[j]) for j in sorted({j for i in places for j in (i - 1, i, i + 1) if 0 <= j < len(lines)})}
    rows = []
    for i in places:
        f = dict(own[i])
        for side, j in (("before", i - 1), ("after", i + 1)):
            if j in own:
                g = own[j]
                f[f"words_{side}"], f[f"links_{side}"], f[f"code_{side}"] = g["words"], g["link_density"], g["code_share"]
                f[f"signs_{side}"] = len(signs[j])
        rows.append([f[k] for k in FEATURES])
    return np.array(rows).reshape(len(rows), len(FEATURES)), signs


class Tree:
    """A decision tree grown by Gini impurity to pure leaves or ``depth``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12):
        classes = int(y.max()) + 1
        self.nodes: list[tuple] = []
        self._grow(x, np.eye(classes)[y], depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        total = y.sum(0)
        best = None
        if depth and (total > 0).sum() > 1:
            for j in range(x.shape[1]):
                order = np.argsort(x[:, j], kind="stable")
                v = x[order, j]
                left = np.cumsum(y[order], 0)[:-1]
                n = np.arange(1, len(v))
                gain = (left**2).sum(1) / n + ((total - left) ** 2).sum(1) / (len(v) - n)
                gain[v[1:] == v[:-1]] = -1
                if len(gain) and gain.max() > 0 and (best is None or gain.max() > best[0] + 1e-9):
                    i = int(gain.argmax())
                    best = gain[i], j, (v[i] + v[i + 1]) / 2
        if best is None:
            self.nodes[at] = (int(total.argmax()),)
            return at
        low = x[:, best[1]] <= best[2]
        self.nodes[at] = (best[1], best[2], self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1))
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[rows] = node[0]
                continue
            low = x[rows, node[0]] <= node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
        return out


    def described(self, names: tuple[str, ...], answers: tuple[str, ...], at: int = 0, indent: str = "") -> str:
        """The tree as text, a line a node."""
        node = self.nodes[at]
        if len(node) == 1:
            return f"{indent}{answers[node[0]]}\n"
        return f"{indent}{names[node[0]]} <= {node[1]:.3g}\n" + self.described(names, answers, node[2], indent + "  ") + f"{indent}else\n" + self.described(names, answers, node[3], indent + "  ")

    def used(self, names: tuple[str, ...]) -> set[str]:
        return {names[n[0]] for n in self.nodes if len(n) > 1}


@lru_cache(maxsize=1)
def labelled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, kinds, whether they hold source) of the blocks of the labelled table."""
    x = np.concatenate([block_features([b[2] for b in t])[0] for t in texts()])
    return x, np.array([KINDS.index(b[0]) for t in texts() for b in t]), np.array([int(b[1]) for t in texts() for b in t])


@lru_cache(maxsize=1)
def trees() -> tuple[Tree, Tree]:
    """(kind of a block, whether it holds markup source), grown once a process."""
    x, kinds, marked = labelled()
    return Tree(x, kinds), Tree(x, marked)


def blocks(text: str) -> list[str]:
    return [x for x in re.split(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]", text) if x.strip()]


def classified(text: str) -> list[tuple[str, bool, str]]:
    """(kind, holds markup source, block) of every block of a text."""
    lines = blocks(text)
    if not lines:
        return []
    x, _ = block_features(lines)
    kind, marked = trees()
    return [(KINDS[k], bool(m), line) for k, m, line in zip(kind.predict(x), marked.predict(x), lines)]


def has_markup(text: str) -> bool:
    """Whether a block of the text holds markup source. The tree calls no block without signs source, whatever its
    neighbours (its first splits are by signs), so only blocks with signs are asked about."""
    if not SPECIAL.search(text):
        return False
    lines = blocks(text)
    signs = [signs_of(x) for x in lines]
    some = [i for i, s in enumerate(signs) if s]
    return bool(some) and bool(trees()[1].predict(block_features(lines, signs, some)[0]).any())


def convertible(lines: list[str]) -> list[bool]:
    """Whether each block holds source that is to be converted: indented code stays as it is, but for tags, entities and
    commands in it."""
    out = [False] * len(lines)
    signs = [signs_of(x) for x in lines]
    some = [i for i, s in enumerate(signs) if s]
    if some:
        x = block_features(lines, signs, some)[0]
        kind, marked = trees()
        for i, k, m in zip(some, kind.predict(x), marked.predict(x)):
            kept = KINDS[k] == "code" and re.match(r" {4}|\t", lines[i]) and all(SIGNS[n][0] not in ("html", "tex") for n, _, _ in signs[i])
            out[i] = bool(m) and not kept
    return out


BLOCK_TAG = re.compile(r"</?(?:address|article|aside|blockquote|body|caption|center|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|section|table|tbody|tfoot|thead|title|tr|ul)\b[^<>]*>", re.I)
CODE_BLOCK = re.compile(
    r"<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?(?P<pre>.*?)(?:</code>\s*)?</pre>|<syntaxhighlight\b[^<>]*>(?P<wiki>.*?)</syntaxhighlight>"
    r"|^[ \t]*(?P<fence>`{3,}|~{3,})[\w+-]*[ \t]*\n(?P<md>.*?)(?:^[ \t]*(?P=fence)[ \t]*$|\Z)|\\begin\{(?P<env>verbatim|lstlisting|minted)\}(?:\[[^\]]*\]|\{[^}]*\})*(?P<tex>.*?)\\end\{(?P=env)\}", re.S | re.M | re.I)


def plain_math(tex: str) -> str:
    """A formula without delimiters; fractions, roots and relations in plain signs. Nested ones are taken from the inside out."""
    bare = lambda p: p.strip() if re.fullmatch(r"\s*(?:[\w.]+|\([^()]*\))\s*", p) else f"({p.strip()})"
    out, before = tex.strip(), None
    while out != before:
        before = out
        out = re.sub(r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", lambda m: f"{bare(m[1])} / {bare(m[2])}", out)
        out = re.sub(r"\\sqrt\s*\{([^{}]*)\}", r"sqrt(\1)", out)
        out = re.sub(r"\\(?:text|mathrm|mathbf|mathit|operatorname)\s*\{([^{}]*)\}", r"\1", out)
        # Braces of an index or exponent that hold no command any more, so that what they group can be taken as well.
        out = re.sub(r"([_^])\{([^{}\\]*)\}", lambda m: m[1] + (m[2] if re.fullmatch(r"\w+", m[2]) else f"({m[2]})"), out)
    for name, sign in (("leq?", "<="), ("geq?", ">="), ("neq?", "!="), ("times", "*"), ("cdot", "*"), ("to", "->"), ("infty", "inf")):
        out = re.sub(rf"\\{name}\b", sign, out)
    return re.sub(r"\\([A-Za-z]+)", r"\1", out)


def clean(text: str) -> str:
    """The text without markup source, its headings, lists, code blocks, formulas and tables kept."""
    text = re.sub(r"\r\n?", "\n", text)
    verdicts = iter(convertible(blocks(text)))
    ends = re.split(r"([\n\x0b\x0c\x85\u2028\u2029])", text)
    clear = [bool(x.strip()) and not next(verdicts) for x in ends[::2]]
    if not any(x.strip() and not c for x, c in zip(ends[::2], clear)):
        return text
    # A line judged clean carries a sign at its end through the steps over many lines; white space to all of them.
    sign = next((c for c in "\x1f\x1e\x1d\x1c" if c not in text), "\x1f")
    ends[::2] = [x.replace(sign, "") + sign * c for x, c in zip(ends[::2], clear)]
    text = "".join(ends)
    kept: list[str] = []

    def keep(content: str) -> str:
        kept.append(content.replace(sign, ""))
        return f"\x00{len(kept) - 1}\x00"

    def code(m: re.Match) -> str:
        content = next(c for c in (m["pre"], m["wiki"], m["md"], m["tex"]) if c is not None)
        if m["pre"] is not None:
            content = html.unescape(re.sub(r"</?(?:span|b|i|em)\b[^<>]*>", "", content))
        return "\n\n" + keep(content.strip("\n")) + "\n\n"

    text = text.replace("\x00", "")
    text = CODE_BLOCK.sub(code, text)
    text = re.sub(r"\A\s*---\n(?:[\w-]+:.*\n)+---\n", "", text)
    text = re.sub(r"<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style|head)\b.*?</\1>|<(ref)\b[^<>/]*>.*?</\2>|<ref\b[^<>]*/>", "", text, flags=re.S | re.I)
    text = re.sub(r"(?:(?<=\n)|\A)\\documentclass.*?\\begin\{document\}|\\end\{document\}", "", text, flags=re.S)
    math = lambda m: keep(plain_math(next(g for g in m.groups() if g is not None)))
    text = re.sub(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|<math\b[^<>]*>(.+?)</math>", lambda m: "\n\n" + math(m) + "\n\n" if "\n" not in m[0].strip("$\n") else "\n\n" + math(m) + "\n\n", text, flags=re.S)
    text = re.sub(r"(?<![\w:\\])\\\((.+?)\\\)", math, text)
    text = re.sub(MATH, lambda m: keep(plain_math(m[0][1:-1])), text)
    # Setext headings and wiki tables span lines; the rest goes line by line.
    text = re.sub(r"(?m)^(\S.*)\n(?:={3,}|-{3,})[ \t]*$", r"\n\1\n", text)
    text = re.sub(r"(?ms)^\{\|[^\n]*\n(.*?)^\|\}[ \t]*$", lambda m: wiki_table(m[1]), text)
    text = re.sub(r"\\begin\{tabular\*?\}(?:\{[^{}]*\})*(.*?)\\end\{tabular\*?\}", lambda m: tex_table(m[1]), text, flags=re.S)
    tex = bool(re.search(TEX_COMMAND, text))
    if re.search(TAG, text, re.I):
        text = re.sub(r"\s*</t[dh]>\s*<t[dh]\b[^<>]*>\s*", "\t", text, flags=re.I)
        text = re.sub(r"<img\b[^<>]*?\balt\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>=]+))[^<>]*>", lambda m: m[1] or m[2] or m[3] or "", text, flags=re.I)
        text = list_marks(text, re.compile(r"<(?P<open>ul|ol)\b[^<>]*>|</(?P<close>ul|ol)\s*>|<(?P<item>li)\b[^<>]*>\s*", re.I), "ol")
        text = re.sub(r"<br\b[^<>]*>", " ", text, flags=re.I)
        text = re.sub(r"</(?:tr|li)>\s*(?=<(?:tr|li)\b)", "\n", text, flags=re.I)
        text = re.sub(r"</?(?:tr|li)\b[^<>]*>", "\n", text, flags=re.I)
        text = BLOCK_TAG.sub("\n\n", text)
        text = re.sub(TAG, "", text, flags=re.I)
    if tex:
        text = list_marks(text, re.compile(r"[ \t]*\\begin\{(?P<open>itemize|enumerate)\}(?:\[[^\]\n]*\])?|[ \t]*\\end\{(?P<close>itemize|enumerate)\}|(?P<item>(?<=\n)[ \t]*\\item)\b[ \t]*(?:\[[^\]\n]*\])?[ \t]*"), "enumerate")
    lines = text.split("\n")
    out = [line.replace(sign, "") if sign in line else plain_line(plain_entities(line), tex) for line in lines]
    text = "\n".join(x for x in out if x is not None)
    text = re.sub(r"\n{3,}", "\n\n", text).strip("\n")
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text)


def list_marks(text: str, tokens: re.Pattern, numbered: str) -> str:
    """Items of nested lists on lines of their own, under the indent of their depth, with a number in lists of the numbered kind."""
    kinds: list[list] = []

    def mark(m: re.Match) -> str:
        if m["open"]:
            kinds.append([m["open"].lower(), 0])
            return "\n"
        if m["close"]:
            del kinds[-1:]
            return "\n"
        if not kinds:
            return "\n• "
        kinds[-1][1] += 1
        return "\n" + "  " * (len(kinds) - 1) + (f"{kinds[-1][1]}. " if kinds[-1][0] == numbered else "• ")

    return tokens.sub(mark, text)


def plain_entities(line: str) -> str:
    """A line with its entities, which end with a semicolon, as signs; those that were escaped once more, too."""
    for _ in range(2):
        line = SIGNS["entity"][1].sub(lambda m: html.unescape(m[0]).replace("\xa0", " "), line)
    return line


def wiki_table(body: str) -> str:
    rows = []
    for row in re.split(r"(?m)^\|-.*$", body):
        cells = [c.strip() for line in row.splitlines() if line[:1] in "|!" and line.strip() for c in re.split(r"\|\||!!", line[1:])]
        rows += ["\t".join(cells)] if cells else []
    return "\n" + "\n".join(rows) + "\n"


def tex_table(body: str) -> str:
    rows = [r.strip() for r in re.split(r"\\\\", body.replace("\\hline", ""))]
    return "\n" + "\n".join("\t".join(c.strip() for c in r.split("&")) for r in rows if r) + "\n"


def plain_line(line: str, tex: bool) -> str | None:
    """A line without line and inline signs; None where nothing but scaffold was there."""
    if SIGNS["rule"][1].match(line) or SIGNS["fence"][1].match(line) or SIGNS["link_target"][1].match(line) or re.match(r"^\s*\|?\s*:?-{3,}:?\s*\|", line):
        return None
    if SIGNS["table_row"][1].match(line):
        return "\t".join(plain_inline(c.strip(), tex) for c in line.strip().strip("|").split("|"))
    line = re.sub(r"^ {0,3}#{1,6}[ \t]+(\S.*?)[ \t]*#*[ \t]*$", r"\n\1\n", line)
    line = re.sub(r"^\s*(={1,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t]*$", r"\n\2\n", line)
    line = re.sub(rf"^\s*{HEAD_TEX}\{{(.*)\}}\s*$", r"\n\1\n", line)
    # A numbered item keeps its number, and a nested one its indent.
    line = re.sub(r"^([ \t]*)(?:[-+]|\*{1,4})[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", lambda m: m[1] + "  " * max(m[0].strip().count("*") - 1, 0) + "• ", line)
    line = re.sub(r"^([ \t]*\d{1,3}\.[ \t]+)\[[ xX]\][ \t]+(?=\S)", r"\1", line)
    line = re.sub(r"^\s*\\item\s*(?:\[[^\]]*\])?\s*", "• ", line)
    line = re.sub(r"^ {0,3}>{1,3}[ \t]+", "", line)
    if re.match(r"^\s*\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\]|\{[^{}]*\})*\s*$", line) or re.match(r"^\s*\\(?:usepackage|title|author|date|maketitle|tableofcontents|label|bibliography\w*)\b.*$", line):
        return None
    out = plain_inline(line, tex)
    return out if out.strip() or not line.strip() else None


def plain_inline(line: str, tex: bool) -> str:
    """A line without inline signs."""
    if not SPECIAL.search(line):
        return line
    line = re.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*\)|(?<![\w\])])\[([^\[\]\n]+)\]\([^()\n]*\)", lambda m: m[1] or m[2] or "", line)
    line = re.sub(r"\[\[(?:File|Image):[^\[\]|]*((?:\|[^\[\]|]*)*)\]\]", lambda m: next((c for c in reversed(m[1].split("|")) if " " in c.strip()), ""), line, flags=re.I)
    line = re.sub(r"\[\[Category:[^\[\]]*\]\]", "", line, flags=re.I)
    line = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]", r"\1", line)
    line = re.sub(r"\{\{(?:[^{}|\n]*\|)*([^{}|\n]*)\}\}", r"\1", line)
    line = re.sub(r"\[\^[\w-]+\]:?", "", line)
    for sign in ("strong", "emphasis"):
        line = SIGNS[sign][1].sub(lambda m: m[0].strip("*_"), line)
    line = SIGNS["strike"][1].sub(lambda m: m[0].strip("~"), line)
    line = SIGNS["tick"][1].sub(lambda m: m[0].strip("`"), line)
    line = SIGNS["wiki_quote"][1].sub(lambda m: m[0].strip("'"), line)
    if tex or "\\" in line:
        line = re.sub(r"(?<![:\\/])\\(?:cite\w*|ref|eqref|label|footnote|pageref)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", "", line)
        line = re.sub(r"\{\\(?:it|bf|em|tt|sl|sc|rm|sf|small|large|Large)\s+([^{}]*)\}", r"\1", line)
        for _ in range(3):
            line = re.sub(r"(?<![:\\/])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", line)
    if tex:
        line = re.sub(r"(?<=\w)~(?=\w)", " ", line)
        line = re.sub(r"``([^`'\n]+)''", r'"\1"', line)
        line = re.sub(r"(?<![\w:\\])\\([%&$#_{}])", r"\1", line)
    return line


def marked(text: Column) -> Column:
    """Whether ``text`` holds markup source; null for null."""
    @F.arrow_udf(T.BooleanType())
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else has_markup(t) for t in texts.to_pylist()], pa.bool_())

    return found(text)


def cleaned(text: Column) -> Column:
    """Clean text of ``text``; null for null."""
    @F.arrow_udf(T.StringType())
    def plain(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else clean(t) for t in texts.to_pylist()], pa.string())

    return plain(text)


def distinct_texts(results: DataFrame) -> DataFrame:
    """(sha256, extracted_text) once each, of the results that have a text."""
    return results.where("sha256 is not null and extracted_text is not null").groupBy("sha256", F.xxhash64("extracted_text")).agg(F.max("extracted_text").alias("extracted_text")).select("sha256", "extracted_text")


def marked_files(results: DataFrame) -> DataFrame:
    """(sha256) of the files with a text that holds markup source."""
    return distinct_texts(results).where(marked(F.col("extracted_text"))).select("sha256").distinct()
