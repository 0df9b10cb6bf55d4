"""Main text of web pages by the maximum-scoring run of words and tags.

A page is a line of tags and of text between tags. Each word of a text scores positive, each tag negative or zero; the
contiguous run with the greatest sum, found by one linear scan, is the content. Weights come from labelled pages: pages
with exactly one article or main element, whose inside is content. A tag's weight falls with the log-odds of standing
outside, and no further than a few words' worth for tags that articles may well hold though the sample's don't: inline ones,
lists, tables and divisions (see LEAST). A link costs its weight times its share of its block's words, so a menu's links count in full
and one in a paragraph hardly. A word scores 1 where its block is a kind that stands inside at least as often as outside, and
a tenth otherwise. Where a page has just one article (or main) without marks that holds words, the run holds all of it.

Within the run, elements that are never article text are left out: those of SKIPPED, and those whose class, id or role
holds a word of ASIDE. Their words score nothing. Wrappers are marked with such words too (has-sidebar, comment-open), so marks
never leave out an element of ROOTS or html by itself, nor one that holds a main or an article without marks, nor one with
over half of the page's words, unless an article or main without marks stands outside it. Readers can write more than the
author: an element that is marked as a whole with a word of COMMENTS is left out though it holds most words, where at least
LEAST_PLAIN words without marks stand outside it.

Attributes are read as HTML has them: quotes count only right after an equals sign, so a stray one swallows nothing.

Defined results: a null or empty page gives an empty text; so does one without words; the earliest of equal runs is taken.
Repeated rows are extracted each. Without labelled pages the weights of DEFAULT hold.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.shared import share_of

#: Labelled pages that weights are fitted on, about: those whose columns' hash is below a bound.
SAMPLE = 4_000
#: Elements by kind, as HTML defines them, and words that sites use for what is no article text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("aside button canvas datalist dialog footer form head header iframe input label menu nav noscript object option script search select style svg template textarea title video audio".split())
#: Elements of the text within blocks. Names of none of these kinds share one feature, so that there are few.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
ASIDE = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies copyright disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
KNOWN = BLOCKS | SKIPPED | VOID | INLINE
COMMENTS, LEAST_PLAIN = frozenset(("comment", "comments", "disqus")), 10
ENDS_P = BLOCKS - {"body", "html", "head", "title", "caption", "option", "optgroup", "legend"}
#: An end tag of SHALLOW closes nothing that lies outside the innermost of ROOTS.
ROOTS, SHALLOW = frozenset(("article", "main", "body")), frozenset(("p", "div", "span", "b", "i", "a"))
DEFAULT = {"a": -1.0, "/a": -1.0, "li": -1.0, "/li": -1.0, "p": 0.0, "/p": 0.0, "": -0.5}
#: Blocks that articles hold as other parts of a page do.
INNER = frozenset("blockquote caption dd details dir div dl dt figcaption figure hgroup hr legend li ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Scale of a tag's log-odds, a word's score in a block that stands mostly outside, and what is added to each count.
SCALE, OUTSIDE, PRIOR = 3.0, 0.1, 2.0
#: The least weights of tags of inline elements, of INNER and of all others.
LEAST = (-2.0, -4.0, -40.0)

#: A tag that nothing ends runs to the end of the page. Nothing is given back, so a page is read in linear time.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")


def marks_of(attributes: str) -> str:
    """The values of class, id and role."""
    return " ".join(x for name, *values in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role") for x in values if x).lower()


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, more): open with the element's marking words, close, or text with the text decoded."""
    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            yield "text", "", html.unescape(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            yield "close", name, ""
            continue
        yield "open", name, marks_of(m["rest"]) if "=" in m["rest"] else ""
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "close", name, ""
    if at < len(page):
        yield "text", "", html.unescape(page[at:])


def parts(page: str) -> Iterator[tuple[str, str, bool, str, bool]]:
    """(feature, block, skipped, text, plain) of each tag and text: the tag's feature, or empty for a text; the innermost block's
    name; whether it lies in an element that is left out; whether it begins an article or a main without marks."""
    rows = list(_parts(page))
    opened: list[list[int]] = []  # marked elements: first row, end, words within, plain roots within, how strongly marked
    inner: list[int] = []
    words = roots = plain_words = 0
    for k, (_, _, skipped, text, marks, plain, closed) in enumerate(rows):
        for _ in range(closed):
            e = opened[inner.pop()]
            e[1:4] = k, words - e[2], roots - e[3]
        if marks:
            inner.append(len(opened))
            opened.append([k, len(rows), words, roots, marks])
        n = 0 if skipped else len(text.split())
        words, roots, plain_words = words + n, roots + plain, plain_words + (0 if inner else n)
    for i in inner:
        opened[i][1:4] = len(rows), words - opened[i][2], roots - opened[i][3]
    left = {b: e for b, e, n, held, strength in opened if not held and (2 * n <= words or roots or strength == 2 and plain_words >= LEAST_PLAIN)}
    end = 0
    for k, (feature, block, skipped, text, _, plain, _) in enumerate(rows):
        end = max(end, left.get(k, 0))
        yield feature, block, skipped or k < end, text, plain and k >= end


def _parts(page: str) -> Iterator[tuple[str, str, bool, str, int, bool, int]]:
    """parts, by SKIPPED alone; whether marks of ASIDE could leave the element out (2: a whole one is a word of COMMENTS); whether it
    is a main or an article without marks; how many such marked elements have ended before."""
    stack: list[tuple[str, bool, bool]] = []
    blocks = [("", -1)]  # names and places in the stack
    opened, within = Counter(), [Counter()]  # names in the whole stack, and above each root in it

    def drop(to: int) -> int:
        ended = 0
        while len(stack) > to:
            name, _, marked = stack.pop()
            ended += marked
            opened[name] -= 1
            if name in BLOCKS:
                blocks.pop()
            if name in ROOTS:
                within.pop()
            else:
                within[-1][name] -= 1
        return ended

    for kind, name, more in tokens(page):
        if kind == "text":
            yield "", blocks[-1][0], bool(stack) and stack[-1][1], more, 0, False, 0
        elif kind == "open":
            ended = 0
            if (name in ENDS_P or name in ("li", "option")) and (blocks[-1][0] == "p" or blocks[-1][0] == name == "li"):
                ended = drop(blocks[-1][1])
            skip = name in SKIPPED or bool(stack) and stack[-1][1]
            aside = bool(more) and not ASIDE.isdisjoint(re.split(r"[^a-z]+", more))
            marked = aside and not skip and name not in ROOTS and name not in VOID and name != "html"
            strength = marked and 2 - COMMENTS.isdisjoint(more.split())
            yield name, name if name in BLOCKS else blocks[-1][0], skip, "", int(strength), name in ("article", "main") and not aside and not skip, ended
            if name not in VOID:
                stack.append((name, skip, marked))
                opened[name] += 1
                if name in BLOCKS:
                    blocks.append((name, len(stack) - 1))
                if name in ROOTS:
                    within.append(Counter())
                else:
                    within[-1][name] += 1
        else:
            skip, ended = bool(stack) and stack[-1][1], 0
            if (within[-1] if name in SHALLOW else opened)[name]:
                ended = drop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            yield "/" + name, blocks[-1][0], skip, "", 0, False, ended


def count(page: str) -> tuple[Counter, Counter]:
    """Features of tags, and blocks of words, inside and outside the one content element; nothing for other pages."""
    inside, outside, at = Counter(), Counter(), 0
    rows = list(parts(page))
    if sum(r[0] in ("article", "main") for r in rows) != 1:
        return inside, outside
    for feature, block, _, text, _ in rows:
        if feature in ("article", "main"):
            at = 1
        elif feature in ("/article", "/main"):
            at = 0
        elif feature:
            name = feature.removeprefix("/")
            (inside if at else outside)[feature if name in KNOWN else ""] += 1
        elif n := len(text.split()):
            (inside if at else outside)[f"#{block}"] += n
    return inside, outside


def weights(inside: Counter, outside: Counter) -> dict[str, float]:
    """Scores by tag feature, and by '#' and the block for words."""
    if not inside:
        return DEFAULT
    a, b, out = sum(inside.values()), sum(outside.values()), {"": -0.5}
    for x in (inside.keys() | outside.keys()) - {""}:
        odds = math.log((inside[x] + PRIOR) / (a + 2 * PRIOR)) - math.log((outside[x] + PRIOR) / (b + 2 * PRIOR))
        name = x.removeprefix("/")
        least = LEAST[0 if name in INLINE else 1 if name in INNER else 2]
        out[x] = (1.0 if odds >= 0 else OUTSIDE) if x[0] == "#" else max(least, min(0.0, SCALE * odds))
    return out


def link_shares(rows: list[tuple[str, str, bool, str, bool]]) -> dict[int, float]:
    """For each tag of a link the share that links have in the words of its line, the text between two tags of blocks."""
    out, tags, words, linked, depth = {}, [], 0, 0, 0
    for k, (feature, _, skipped, text, _) in enumerate([*rows, ("p", "", False, "", False)]):
        name = feature.removeprefix("/")
        if name == "a":
            tags.append(k)
            depth = int(feature == "a")
        elif name in BLOCKS:
            out.update((t, linked / words if words else 1.0) for t in tags)
            tags, words, linked = [], 0, 0
        elif not feature and not skipped:
            n = len(text.split())
            words, linked = words + n, linked + n * depth
    return out


def sole_article(rows: list[tuple[str, str, bool, str, bool]]) -> tuple[int, int] | None:
    """First and last row of the one article without marks, or else of the one such main."""
    for name in ("article", "main"):
        begins = [k for k, r in enumerate(rows) if r[4] and r[0] == name]
        if len(begins) == 1:
            depth = 0
            for k in range(begins[0], len(rows)):
                depth += (rows[k][0] == name) - (rows[k][0] == "/" + name)
                if not depth:
                    return begins[0], k + 1
            return begins[0], len(rows)
        if begins:
            return None
    return None


def extract(page: str, scores: dict[str, float]) -> str:
    """The text of the best run."""
    rows = list(parts(page))
    shares = link_shares(rows)
    best, begin, end, total, start, other = 0.0, 0, 0, 0.0, 0, scores.get("", -0.5)
    for k, (feature, block, skipped, text, _) in enumerate(rows):
        if feature:
            total += scores.get(feature, 0.0 if feature.strip("/") in ("article", "main") else other) * shares.get(k, 1.0)
        elif not skipped:
            total += scores.get(f"#{block}", 1.0) * len(text.split())
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, begin, end = total, start, k + 1
    if (whole := sole_article(rows)) and any(r[3].split() for r in rows[slice(*whole)] if not r[2]):
        meets = best and begin < whole[1] and whole[0] < end
        begin, end = (min(begin, whole[0]), max(end, whole[1])) if meets else whole
    lines, line = [], []
    for feature, _, skipped, text, _ in rows[begin:end]:
        name = feature.removeprefix("/")
        if name in BLOCKS:
            lines.append("".join(line))
            line = []
        elif name == "br":
            line.append(" ")
        elif not feature and not skipped:
            line.append(text)
    return "\n".join(x for x in (" ".join(y.split()) for y in [*lines, "".join(line)]) if x)


def fit(pages: DataFrame, page: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from labelled pages. The sample's counts are summed by feature before they come to the driver."""
    labelled = pages.filter(F.lower(page).rlike("<(article|main)[ >]"))
    n = labelled.count()
    # by all plain columns, so that copies of a page with ids of their own are chosen each by itself
    chosen = labelled.filter(share_of(sample, n, *(f.name for f in pages.schema if isinstance(f.dataType, T.AtomicType))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                for side, found in enumerate(count(x)):
                    total.update({(k, side): v for k, v in found.items()})
        columns = [pa.array([k for k, _ in total], pa.string()), pa.array([s for _, s in total], pa.int32()), pa.array(list(total.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "side", "n"])

    found = chosen.select(page).mapInArrow(run, "feature string, side int, n long").groupBy("feature", "side").agg(F.sum("n").alias("n"))
    rows = found.collect()  # a row for each known element and block and each side
    return weights(*(Counter({r["feature"]: r["n"] for r in rows if r["side"] == side}) for side in (0, 1)))


def main_text(pages: DataFrame, page: str = "html", text: str = "text", scores: dict[str, float] | None = None) -> DataFrame:
    """pages with the main text of each; a column of that name is replaced. scores: weights, else fitted on these pages."""
    scores = fit(pages, page) if scores is None else scores
    kept = pages.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [extract(x, scores) if x else "" for x in batch.column(batch.schema.get_field_index(page)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], names=[*batch.schema.names, text])

    return kept.mapInArrow(run, schema)
