"""The text of HTML, read by one pass over its tags, comments and references."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A tag with its name: attributes' values in quotation marks may hold any sign; a tag without its end goes up to the end of the text.
TAG = re.compile(r"""</?([A-Za-z][^\s/>]*+)(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>?""")
#: Elements whose content is no text, and those that stand in a line with their neighbours.
HIDDEN = frozenset(("script", "style"))
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())


def html_pieces(text: str) -> list[str]:
    """The runs of text between the tags, in order, references decoded; runs that only inline elements part are one.

    Comments, declarations and what stands in script and style are left out. A ``<`` that
    opens nothing is text. A comment or hidden element without its end reaches to the end
    of the text; a quotation mark without its end is a sign like others, so no text is lost.
    """
    out: list[str] = []
    run: list[str] = []
    at, n = 0, len(text)

    def close() -> None:
        whole = html.unescape("".join(run)).strip()
        if whole:
            out.append(whole)
        run.clear()

    while at < n:
        sign = text.find("<", at)
        if sign < 0:
            run.append(text[at:])
            break
        run.append(text[at:sign])
        if text.startswith("<!--", sign):
            end = text.find("-->", sign + 4)
            at = n if end < 0 else end + 3
        elif text.startswith(("<!", "<?"), sign):
            end = text.find(">", sign)
            at = n if end < 0 else end + 1
        elif (m := TAG.match(text, sign)) is not None:
            name, at = m[1].lower(), m.end()
            if name not in INLINE:
                close()
            if name in HIDDEN and text[sign + 1] != "/":
                end = re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(text, at)
                at = n if end is None else end.start()
        else:
            run.append("<")
            at = sign + 1
    close()
    return out


def has_tag(text: str) -> bool:
    return TAG.search(text) is not None or "<!" in text


@F.pandas_udf(T.StringType())
def read_html(text: pd.Series) -> pd.Series:
    """The runs of text of an HTML text, one a line; a text without tags stays as it is."""
    return text.map(lambda t: None if t is None else "\n".join(html_pieces(t)) if has_tag(t) else t)
