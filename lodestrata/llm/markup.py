"""Markup residue in texts (problem 6): what of it there is, and the text without it.

clean() turns HTML, Markdown, wiki and LaTeX into blocks (heading, text, list item, table, code,
formula). Blocks are then classified in two passes: length, stop-word density and link density
decide those they can; short or ambiguous blocks inherit the label of their nearest decided
neighbours. Nothing is dropped from clean_text; main_text leaves out blocks labelled boilerplate.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lodestrata.llm.deliveries import latest_delivery

#: Names of HTML elements and of the tags that wikis add.
TAGS = (
    "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dir div dl dt em "
    "fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math meta nav noscript "
    "object ol optgroup option p param pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead "
    "time title tr track tt u ul var video wbr ref references nowiki gallery syntaxhighlight"
)
#: LaTeX commands that stand without an argument in braces.
TEX_WORDS = (
    "item hline toprule midrule bottomrule cline left right cdot times div pm leq geq neq approx infty sum prod int partial nabla alpha beta gamma delta epsilon theta lambda mu pi rho "
    "sigma tau phi omega Delta Sigma Omega ldots dots quad qquad newline par noindent centering maketitle tableofcontents newpage clearpage displaystyle limits to rightarrow Rightarrow"
)
_TAG = TAGS.replace(" ", "|")
_ENTITY_NAME = "|".join(sorted({k.rstrip(";") for k in html.entities.html5}, key=lambda k: (-len(k), k)))
#: Entities that browsers read without a semicolon.
_BARE_NAME = "|".join(sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))

#: Kinds of markup and the pattern of each. Line patterns rest on MULTILINE.
CONSTRUCTS: dict[str, re.Pattern] = {
    name: re.compile(pattern, re.MULTILINE)
    for name, pattern in {
        "html comment": r"<!--|-->|<!(?i:doctype)|<!\[CDATA\[|<\?xml",
        "html tag": rf"<\s?/?\s?(?i:{_TAG})(?:\s[^<>]*|/)?\s*>|</?[A-Za-z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))*\s*/?>|<(?i:{_TAG})(?:\s+[\w:-]+\s*=|\s*$|\s*<)|</\s?(?i:{_TAG})\b|<(?i:{_TAG})\s*/?>?<",
        "entity": rf"&(?:{_ENTITY_NAME});|&#\d{{1,7}};?|&#[xX][0-9A-Fa-f]{{1,6}};?|&(?:{_BARE_NAME}|apos|ndash|mdash)\b",
        "markdown heading": r"^[ ]{0,3}#{1,6}[ \t]+\S|^[ ]{0,3}#{2,6}\w|^\S.*\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*$|^[ ]{0,3}={3,}[ \t]*$",
        "markdown rule": r"^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$",
        "markdown strong": r"\*\*(?=[^\s\d*])|(?<=[^\s\d*])\*\*|\*\*(?=\S[^*\n]*\*\*)|(?<!\w)__(?=\S)[^_\n]+__(?!\w)",
        "markdown emphasis": r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])|(?<![\w\\])_(?=[^\s_])(?:[^_\n]|(?<=\w)_(?=\w))*?(?<=[^\s_])_(?!\w)|~~(?=\S)",
        "markdown code": r"`|^~~~",
        "markdown link": r"!?\[[^\[\]\n]*\]\((?=\S)|\]\((?:/|#|\.|https?:|mailto:|www\.|[\w-]+[./])|!\[[^\]\n]*\]|\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^[ ]{0,3}\[[^\]\n]+\]:[ \t]+\S|\[\^[\w-]+\]|<(?:https?|mailto|ftp):[^\s<>]+>",
        "markdown quote": r"^[ ]{0,3}>+[ \t]+[^\s\d]|^[ ]{0,3}>{2,}|^[ ]{0,3}>[A-Za-z]",
        "markdown list": r"^[ \t]*[-*+][ \t]+\S|^[ \t]*\d{1,3}[.)][ \t]+\S.*\n+[ \t]*\d{1,3}[.)][ \t]+\S",
        "markdown table": r"^[ \t]*\|.*\|[ \t]*$|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[^|\n]+\|",
        "escape": r"\\[*_#`\[\]()~>|]",
        "wiki heading": r"^={2,6}[^=\n]+",
        "wiki emphasis": r"'{3,}|''(?=[^'\s])[^'\n]+''",
        "wiki link": r"\[\[(?=[A-Za-z:#/])|(?<=[\w)])\]\]|\[(?:https?|ftp)://[^\s\]]+[^\]\n]*\]",
        "wiki template": r"\{\{\s*[#\w]|(?<=[\w)])\}\}",
        "wiki table": r"^\{\||^\|[-}]|^![^!\n]+!!|^\|[^|\n]*\|\|",
        "wiki word": r"__[A-Z]{3,}__|~{4,}|#REDIRECT",
        "tex command": rf"\\[A-Za-z]+\*?[ \t]*(?:\[[^\]\n]*\])?\{{|(?<![A-Za-z:\\])\\(?:{TEX_WORDS.replace(' ', '|')})(?![A-Za-z])|\\begin\b|\\end\b",
        "tex break": r"(?<![:\w\\])\\\\(?=\s|$|[*\[_])",
        "tex escape": r"\\[%$&{}]",
        "tex math": r"\$\$|\\[()\[\]]|(?<![\w$])\$(?=[^\s\d$])[^$\n]*[\\^_{}=][^$\n]*\$|(?<![\w$])\$(?=[^\s\d$])[^$\n]*\\[A-Za-z][^$\n]*\$",
    }.items()
}
#: What a text, with a line end put before it, must hold for a construct to be looked for: any of
#: these strings, or a match of the pattern.
_TRIGGERS: dict[str, tuple[str, ...] | re.Pattern] = {
    "html comment": ("<!", "-->", "<?"),
    "html tag": ("<",),
    "entity": ("&",),
    "markdown heading": re.compile(r"\n[ ]{0,3}(?:#|===|---)"),
    "markdown rule": re.compile(r"\n[ ]{0,3}(?:\*|-|_)[ \t]*(?:\*|-|_)"),
    "markdown strong": ("**", "__"),
    "markdown emphasis": ("*", "_", "~~"),
    "markdown code": ("`", "\n~~~"),
    "markdown link": ("](", "![", "][", "[^", "\n[", "\n [", "<http", "<mailto", "<ftp"),
    "markdown quote": re.compile(r"\n[ ]{0,3}>"),
    "markdown list": re.compile(r"\n[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]"),
    "markdown table": ("|",),
    "escape": ("\\",),
    "wiki heading": ("\n==",),
    "wiki emphasis": ("''",),
    "wiki link": ("[[", "]]", "[http", "[ftp"),
    "wiki template": ("{{", "}}"),
    "wiki table": ("\n{|", "\n|", "\n!"),
    "wiki word": ("__", "~~~~", "#REDIRECT"),
    "tex command": ("\\",),
    "tex break": ("\\\\",),
    "tex escape": ("\\",),
    "tex math": re.compile(r"\$[^\s\d]|\\[()\[\]]"),
}

def constructs(text: str | None) -> list[str]:
    """Names of the kinds of markup a text holds, broken markup included."""
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    led, found = "\n" + text, []
    for name, trigger in _TRIGGERS.items():
        if (trigger.search(led) if isinstance(trigger, re.Pattern) else any(x in led for x in trigger)) and CONSTRUCTS[name].search(text):
            found.append(name)
    return found


@dataclass
class Block:
    kind: str  # heading, text, item, table, code, formula
    text: str
    level: int = 0
    link_characters: int = 0
    label: str = ""


# --- whole constructs that become one block ------------------------------------------------------

_CODE_FENCE = re.compile(r"^[ ]{0,3}(?P<mark>```+|~~~+)[^\n]*\n(?P<body>.*?)(?:^[ ]{0,3}(?P=mark)|\Z)", re.MULTILINE | re.DOTALL)
_CODE_HTML = re.compile(r"<(?P<t>pre|syntaxhighlight|nowiki)\b[^>]*>(?P<body>.*?)(?:</(?P=t)\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_CODE_TEX = re.compile(r"\\begin\{(?P<t>verbatim|lstlisting)\}(?P<body>.*?)(?:\\end\{(?P=t)\}|\Z)", re.DOTALL)
_FORMULA = re.compile(r"\$\$(?P<a>.+?)(?:\$\$|\Z)|\\\[(?P<b>.+?)\\\]|\\begin\{(?P<t>equation|align|displaymath|gather)\*?\}(?P<c>.+?)(?:\\end\{(?P=t)\*?\}|\Z)|<math\b[^>]*>(?P<d>.+?)(?:</math\s*>|\Z)", re.DOTALL | re.IGNORECASE)
_TABLE_HTML = re.compile(r"<table\b[^>]*>(?P<body>.*?)(?:</table\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_TABLE_WIKI = re.compile(r"^\{\|[^\n]*\n(?P<body>.*?)(?:^\|\}|\Z)", re.MULTILINE | re.DOTALL)
_TABLE_TEX = re.compile(r"\\begin\{(?P<t>tabular[x*]?|longtable)\}(?:\[[^\]]*\])?(?:\{[^{}]*\})*(?P<body>.*?)(?:\\end\{(?P=t)\}|\Z)", re.DOTALL)
_LIST_TEX = re.compile(r"\\begin\{(?P<t>itemize|enumerate|description)\}(?P<body>.*?)(?:\\end\{(?P=t)\}|\Z)", re.DOTALL)
_INVISIBLE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!(?:doctype|\[CDATA\[)[^>]*>?|<\?xml[^>]*\?>", re.IGNORECASE | re.DOTALL)

_INLINE_MATH = re.compile(r"\\\((?P<a>.+?)\\\)|(?<![\w$])\$(?P<b>(?=[^\s\d$])[^$\n]*[\\^_{}=][^$\n]*)\$")
_IMAGE = re.compile(r"!\[(?P<alt>[^\]\n]*)\](?:\([^()\n]*(?:\([^()]*\)[^()\n]*)?\)?|\[[^\]\n]*\])?")
_LINK = re.compile(r"\[(?P<text>[^\[\]\n]+)\](?:\((?=[/#.]|https?:|mailto:|www\.|[\w-]+[./])[^()\s]*(?:\([^()]*\)[^()\s]*)?(?:\s+\"[^\"]*\")?\)?|\[[^\[\]\n]*\])")
_LINK_HTML = re.compile(r"<a\b[^>]*>(?P<text>.*?)</\s?a\s*>", re.IGNORECASE | re.DOTALL)
_LINK_WIKI = re.compile(r"\[\[(?:[^\[\]|\n]*\|)*(?P<text>[^\[\]|]*?)\]\]")
_LINK_OUT = re.compile(r"\[(?:https?|ftp)://[^\s\]]+\s*(?P<text>[^\]\n]*)\]")
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>(?:(?:(?!<ref\b).){0,200}?</\s?ref\s*>)?", re.IGNORECASE | re.DOTALL)
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_TEX_NOTE = re.compile(r"\\(?:footnote|label|cite[pt]?|ref|vspace|hspace|includegraphics)\*?(?:\[[^\]]*\])?\{(?P<text>[^{}]*)\}")
_TEX_ARGUMENT = re.compile(r"\\[A-Za-z]+\*?[ \t]*(?:\[[^\]\n]*\])?\{(?P<text>[^{}]*)\}")
_TAG_ANY = re.compile(rf"<\s?/?\s?(?:{_TAG})(?:\s[^<>]*|/)?\s*>|</?[A-Za-z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))*\s*/?>|</?(?:{_TAG})(?:\s+[\w:-]+\s*=\s*(?:\"[^\"\n]*\"?|'[^'\n]*'?|[^\s<>]*))*\s*(?=<|$)|</\s?(?:{_TAG})\b", re.IGNORECASE | re.MULTILINE)
_BREAKING = re.compile(r"</?\s?(?:p|div|section|article|blockquote|ul|ol|dl|table|tr|header|footer|nav|main|aside|figure|hr)\b[^<>]*>", re.IGNORECASE)


def formula_text(source: str) -> str:
    """A TeX formula on one plain line: fractions as quotients, commands as their words."""
    s = source
    for _ in range(8):
        t = re.sub(r"\\d?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"(\1) / (\2)", s)
        t = re.sub(r"\\sqrt\s*\{([^{}]*)\}", r"sqrt(\1)", t)
        t = re.sub(r"([_^])\{([^{}]*)\}", r"\1\2", t)
        t = re.sub(r"\\(?:text|mathrm|mathbf|operatorname|textbf|textit)\s*\{([^{}]*)\}", r"\1", t)
        if t == s:
            break
        s = t
    s = re.sub(r"\\(?:left|right|displaystyle|limits|big[lr]?|[,;!])(?![A-Za-z])\.?", "", s)
    s = re.sub(r"\\(?:cdot|times)(?![A-Za-z])", "*", s)
    s = re.sub(r"\\([%$&#_{}])", r"\1", s).replace("\\\\", " ; ")
    s = re.sub(r"\\([A-Za-z]+)", r"\1", s)
    return " ".join(s.replace("{", "").replace("}", "").replace("&", " ").split())


def inline_text(s: str) -> tuple[str, int]:
    """A run of text without inline markup, and how many of its characters were links."""
    links = 0

    def linked(m: re.Match) -> str:
        nonlocal links
        text = m["text"].strip()
        links += len(text)
        return text

    codes: list[str] = []

    def kept(text: str) -> str:
        codes.append(text)
        return f"\x01{len(codes) - 1}\x01"

    s = re.sub(r"(`+)([^`\n]+?)\1(?!`)", lambda m: kept(m[2].strip()), s)
    s = re.sub(r"<code\b[^>]*>(.*?)</\s?code\s*>", lambda m: kept(html.unescape(m[1])), s, flags=re.IGNORECASE | re.DOTALL)
    s = _INLINE_MATH.sub(lambda m: kept(formula_text(m["a"] or m["b"])), s)
    s = _REF.sub(" ", s)
    s = _IMAGE.sub(lambda m: f" {m['alt']} " if m["alt"].strip() else " ", s)
    for pattern in (_LINK_HTML, _LINK_WIKI, _LINK_OUT, _LINK):
        s = pattern.sub(linked, s)
    s = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?(?=[A-Za-z:#/])|(?<=[\w)])\]\]", "", s)
    s = re.sub(r"\]\((?:/|#|\.|https?:|www\.)[^()\s]*\)?", "", s)
    for _ in range(4):
        s = _TEMPLATE.sub(" ", s)
    s = re.sub(r"\{\{\s*(?=[#\w])|(?<=[\w)])\}\}", "", s)
    s = re.sub(r"<br\s*/?>", "\n", s, flags=re.IGNORECASE)
    s = _TAG_ANY.sub("", s)
    # entities may be escaped twice, and may hide tags
    for _ in range(2):
        plain = html.unescape(s).replace("\xa0", " ")
        s = _TAG_ANY.sub("", plain) if plain != s else s
    for _ in range(6):
        t = _TEX_NOTE.sub(lambda m: f" ({m['text'].strip()})" if "footnote" in m[0][:10] else "", s)
        t = _TEX_ARGUMENT.sub(r"\g<text>", t)
        if t == s:
            break
        s = t
    s = re.sub(rf"(?<![A-Za-z:\\])\\(?:{TEX_WORDS.replace(' ', '|')})(?![A-Za-z])", " ", s)
    s = re.sub(r"\\(?:begin|end)\b(?:\{[^}]*\}?)?|(?<![:\w\\])\\\\(?=\s|$|[*\[_])", " ", s)
    s = re.sub(r"\\([%$&#_{}*`\[\]()~>|])", r"\1", s)
    s = re.sub(r"'{2,5}", "", s) if re.search(CONSTRUCTS["wiki emphasis"], s) else s
    s = re.sub(r"~~(\S(?:.*?\S)?)~~", r"\1", s)
    s = re.sub(r"\*\*(?=\S[^*\n]*\*\*)|(?<=\S)\*\*(?!\d)|\*\*(?=[^\s\d*])", "", s)
    s = re.sub(r"(?<!\w)__(?=\S)([^_\n]+)__(?!\w)", r"\1", s)
    s = re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])", r"\1", s)
    s = re.sub(r"(?<!\w)_(?=[^\s_])((?:[^_\n]|(?<=\w)_(?=\w))*?[^\s_])_(?!\w)", r"\1", s)
    s = re.sub(r"\[\^[\w-]+\]", "", s).replace("`", "")
    s = re.sub("\x01(\\d+)\x01", lambda m: codes[int(m[1])], s)
    s = re.sub(r"[ \t\xa0]+", " ", s)
    return re.sub(r" *\n *", "\n", s).strip(), links


def _cells(rows: list[list[str]]) -> str:
    """Tab-separated lines; blank rows are left out."""
    return "\n".join("\t".join(inline_text(c)[0].replace("\n", " ") for c in row) for row in rows if any(c.strip() for c in row))


def _html_table(body: str) -> str:
    rows = re.split(r"<tr\b[^>]*>", body, flags=re.IGNORECASE)
    return _cells([re.split(r"<t[hd]\b[^>]*>", row, flags=re.IGNORECASE)[1:] or [row] for row in rows])


def _wiki_table(body: str) -> str:
    rows = re.split(r"^\|-.*$", body, flags=re.MULTILINE)
    return _cells([[c for line in row.split("\n") if line.strip() for c in re.split(r"\|\||!!", re.sub(r"^\s*(?:\|\+?|!)", "", line))] for row in rows])


def _tex_table(body: str) -> str:
    body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", body)
    return _cells([re.split(r"(?<!\\)&", row) for row in re.split(r"\\\\", body)])


_LINE_HEADING = re.compile(r"^[ ]{0,3}(?P<atx>#{1,6})[ \t]*(?P<a>[^\d#].*?|\d.*?)[ \t]*#*[ \t]*$|^(?P<wiki>={1,6})[ \t]*(?P<b>[^=\n].*?)[ \t]*={1,6}[ \t]*$|^\\(?P<tex>chapter|(?:sub){0,2}section|paragraph)\*?\{(?P<c>[^{}\n]*)\}[ \t]*|^<h(?P<html>[1-6])\b[^>]*>(?P<d>.*?)(?:</h[1-6]\s*>|$)", re.IGNORECASE)
_LINE_ITEM = re.compile(r"^(?P<indent>[ \t]*)(?:(?P<mark>[-+]|\*{1,6})[ \t]+|(?P<number>\d{1,3})[.)][ \t]+|<li\b[^>]*>[ \t]*)(?P<text>\S.*)$", re.IGNORECASE)
_TEX_DEPTH = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def blocks_of(text: str, again: int = 2) -> list[Block]:
    """The blocks of a text, in order, without their markup.

    Markup may be nested across its own ends, so what a block still holds is removed once more;
    code blocks and formulas are left as they are.
    """
    s = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "").replace("\x01", "")
    whole: list[Block] = []

    def put(kind: str, body: str) -> str:
        whole.append(Block(kind, body))
        return f"\n\n\x00{len(whole) - 1}\x00\n\n"

    s = _CODE_FENCE.sub(lambda m: put("code", m["body"].strip("\n")), s)
    s = _CODE_HTML.sub(lambda m: put("code", html.unescape(re.sub(r"<[^<>]+>", "", m["body"])).strip("\n")), s)
    s = _CODE_TEX.sub(lambda m: put("code", m["body"].strip("\n")), s)
    s = _INVISIBLE.sub(" ", s)
    s = _FORMULA.sub(lambda m: put("formula", formula_text(m["a"] or m["b"] or m["c"] or m["d"])), s)
    s = _TABLE_HTML.sub(lambda m: put("table", _html_table(m["body"])), s)
    s = _TABLE_WIKI.sub(lambda m: put("table", _wiki_table(m["body"])), s)
    s = _TABLE_TEX.sub(lambda m: put("table", _tex_table(m["body"])), s)
    s = _LIST_TEX.sub(lambda m: "\n\n" + "\n".join(f"- {x.strip()}" for x in re.split(r"\\item(?:\[[^\]]*\])?", m["body"])[1:]) + "\n\n", s)
    s = re.sub(r"(?=<li\b)", "\n", s, flags=re.IGNORECASE)
    s = re.sub(r"(?=<h[1-6]\b)|(?<=</h[1-6]>)", "\n\n", s, flags=re.IGNORECASE)
    lone_row = re.match(r"\s*<tr\b", s, re.IGNORECASE)
    if lone_row:
        s = put("table", _html_table(s))
    s = _BREAKING.sub("\n\n", s)

    blocks: list[Block] = []
    lines, held, table = s.split("\n"), [], []

    def close() -> None:
        if table:
            blocks.append(Block("table", _cells([r for r in table])))
            table.clear()
        if held:
            plain, links = inline_text("\n".join(held))
            held.clear()
            if plain:
                blocks.append(Block("table" if plain.count("\t") > 1 else "text", plain, link_characters=links))

    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if m := re.fullmatch("\x00(\\d+)\x00", line.strip()):
            close()
            block = whole[int(m[1])]
            if block.text.strip():
                blocks.append(block)
        elif not line.strip():
            close()
        elif re.fullmatch(r"[ ]{0,3}(?:={3,}|-{3,})[ \t]*", line) and held and len(held) == 1:
            title = held.pop()
            close()
            blocks.append(Block("heading", inline_text(title)[0], 1 if "=" in line else 2))
        elif re.fullmatch(r"[ ]{0,3}(?:={3,}|(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})[ \t]*", line):
            close()
        elif (m := _LINE_HEADING.match(line)) and (m["atx"] is None or len(m["atx"]) > 1 or re.match(r"^[ ]{0,3}#[ \t]", line)):
            close()
            level = len(m["atx"] or m["wiki"] or "") or (int(m["html"]) if m["html"] else _TEX_DEPTH[m["tex"].lower()])
            title = inline_text(m["a"] or m["b"] or m["c"] or m["d"] or "")[0]
            if title:
                blocks.append(Block("heading", title, level))
            if m["tex"] and line[m.end() :].strip():
                held.append(line[m.end() :])
        elif re.match(r"^[ \t]*\|", line) or (re.search(r"\|", line) and i < len(lines) and re.match(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", lines[i])):
            if held:
                close()
            if not re.fullmatch(r"[ \t|:-]+", line):
                table.append(re.split(r"(?<!\\)\|", line.strip().strip("|")))
            elif re.fullmatch(r"[ \t]*\|[ \t|]*", line):
                close()
        elif re.search(r"(?<!\\)&.*(?<![:\w\\])\\\\", line):
            if held:
                close()
            table.append(re.split(r"(?<!\\)&", re.sub(r"\\\\.*$", "", line)))
        elif m := _LINE_ITEM.match(line):
            close()
            plain, links = inline_text(m["text"])
            if plain:
                blocks.append(Block("item", plain, 1 + len(m["indent"].expandtabs(4)) // 2 + max(0, len(m["mark"] or "*") - 1), links))
        else:
            if table:
                close()
            held.append(re.sub(r"^[ ]{0,3}(?:>[ \t]?)+(?=[^\s\d]|$)", "", line))
    close()
    out: list[Block] = []
    for b in blocks:
        if again and b.kind in ("heading", "text", "item") and constructs(b.text):
            inner = blocks_of(b.text, again - 1)
            if len(inner) == 1:
                inner[0].kind, inner[0].level = b.kind, b.level
            out += inner
        elif b.text.strip():
            out.append(b)
    return out


# --- two-pass classification ---------------------------------------------------------------------

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    "a about after all an and any are as at be been by for from had has have in into is it its more no not of on or other over per some than that the their them there these they this to under up was were which while will with would you "
    "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer für gegen hat im in ist kann mit nach nicht noch oder sich sind so sowie über um und unter von vor war werden wird wurde zu zum zur "
    "au aux avec ce ces cette contre dans de des du elle en est et la le les leur lors mais ne nous ont ou par pas plus pour qu que qui sa ses son sont sous sur un une "
    "al como con contra cual cuando de del desde el en entre era es esta este fue ha han hasta la las lo los más no o para pero por que se según ser sin sobre su sus un una y".split()
)


@dataclass(frozen=True)
class BlockRules:
    """Thresholds of the first pass; lengths in characters, densities as shares."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.20
    stop_high: float = 0.30
    link_density: float = 0.35
    kept_kinds: tuple[str, ...] = field(default=("table", "code", "formula"))


def classify(blocks: list[Block], rules: BlockRules = BlockRules()) -> None:
    """Label every block content or boilerplate."""
    first: list[str] = []
    for b in blocks:
        words = re.findall(r"[^\W\d_]+", b.text.casefold())
        stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if b.kind in rules.kept_kinds:
            first.append("content")
        elif b.link_characters > rules.link_density * len(b.text):
            first.append("boilerplate")
        elif b.kind in ("heading", "item") or len(b.text) < rules.short:
            first.append("short")
        elif stops >= rules.stop_high:
            first.append("content" if len(b.text) > rules.long else "near")
        elif stops >= rules.stop_low:
            first.append("near")
        else:
            first.append("boilerplate" if words else "short")
    decided = [x if x in ("content", "boilerplate") else "" for x in first]
    before: list[tuple[str, int]] = []
    last = ("", 1 << 30)
    for i, x in enumerate(decided):
        before.append(last)
        last = (x, i) if x else last
    last = ("", -(1 << 30))
    for i in range(len(blocks) - 1, -1, -1):
        label = decided[i]
        if not label:
            left, right = before[i], last
            if left[0] == right[0]:
                label = left[0] or "content"
            elif not left[0] or not right[0]:
                label = left[0] or right[0]
            elif first[i] == "near" or blocks[i].kind == "heading":
                label = "content"  # between both kinds, prose and titles are kept
            else:
                label = left[0] if i - left[1] < right[1] - i else right[0]
            if first[i] == "near" and label == "boilerplate" and left[0] != right[0]:
                label = "content"
        blocks[i].label = label
        if decided[i]:
            last = (decided[i], i)


def render(blocks: list[Block]) -> str:
    """Plain text: headings and paragraphs apart, items with a bullet, cells by tabs, code indented."""
    parts: list[str] = []
    for i, b in enumerate(blocks):
        if b.kind == "item":
            line = "  " * (b.level - 1) + "• " + b.text.replace("\n", " ")
            if i and blocks[i - 1].kind == "item":
                parts[-1] += "\n" + line
            else:
                parts.append(line)
        elif b.kind == "code":
            parts.append("\n".join("    " + x for x in b.text.split("\n")))
        else:
            parts.append(b.text)
    return "\n\n".join(parts)


def clean(text: str | None) -> tuple[str | None, str | None, list[Block], list[str]]:
    """Clean text, main text, blocks and the kinds of markup found; None texts for a null text."""
    if text is None:
        return None, None, [], []
    found = constructs(text)
    blocks = blocks_of(text) if found else [Block("table" if "\t" in p else "text", p.strip()) for p in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n")) if p.strip()]
    classify(blocks)
    return (render(blocks) if found else text), render([b for b in blocks if b.label == "content"]), blocks, found


_BLOCK_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType())])
CLEANED = T.StructType([
    T.StructField("table_name", T.StringType()), T.StructField("row_key", T.StringType()), T.StructField("constructs", T.ArrayType(T.StringType())),
    T.StructField("clean_text", T.StringType()), T.StructField("main_text", T.StringType()), T.StructField("blocks", T.ArrayType(_BLOCK_TYPE)),
])


def _arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("label", pa.string()), ("text", pa.string())])
    types = [pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(block)]
    for batch in batches:
        out: list[tuple] = []
        for text in batch.column(2):
            cleaned, main, blocks, found = clean(text.as_py())
            out.append((found, cleaned, main, [{"kind": b.kind, "level": b.level, "label": b.label, "text": b.text} for b in blocks]))
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, kind) for c, kind in zip(columns, types))], names=CLEANED.fieldNames())


def markup_rows(df: DataFrame, *, table_name: str, row_key: str, text: str, arrived: str = "received_at") -> DataFrame:
    """(table_name, row_key, text, arrived) of one table."""
    return df.select(F.lit(table_name).alias("table_name"), F.col(row_key).cast("string").alias("row_key"), F.col(text).alias("text"), F.col(arrived).alias("arrived"))


def clean_markup(rows: DataFrame) -> DataFrame:
    """(table_name, row_key, constructs, clean_text, main_text, blocks) of every row of markup_rows().

    Deliveries of one key count once, by the latest; rows without key all stay. A null text stays
    null, an empty one empty, a text without markup as it is. constructs is empty where there is
    none. Whole texts are read.
    """
    keyed = rows.withColumn("_key", F.when(F.col("row_key").isNotNull(), F.struct("table_name", "row_key")))
    once = latest_delivery(keyed, "_key", ["table_name", "row_key", "text"], "arrived")
    return once.select("table_name", "row_key", "text").mapInArrow(_arrow, CLEANED)
