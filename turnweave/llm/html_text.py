"""Operator 1: main text of HTML pages by markup and by comparing neighbouring pages of a host.

A page becomes lines: one for each block of text, with white space turned into single spaces and character
references decoded, and with a mark that says whether the markup around it is part of the article.  Pages are
sorted by host and URL path, and each is paired with its nearest neighbour on the same host whose lines are not the
same as its own, before or after it, the one that shares the longer beginning of the path.  The lines of a pair are
aligned by a longest common subsequence, and shared lines are deleted as the host's template, unless the page marks
them as its article: near copies of an article occur on one host, so deleting lines inside `article` or `main` would
take text that is the page's own.  A page with such a mark is its marked lines, whatever their length; on all others the comparison
decides on every line that is not clearly furniture.

Tags are read by the rules of HTML (quotes, values without quotes, end tags left out, self-closing foreign elements), in
time linear in the page.  An `article` or `main` is believed inside any wrapper but clear furniture (nav, aside, footer,
reader comments, adverts, related pages); a form or a banner may hold the page.

Defined results: null or empty html gives an empty text with n_chars 0; a null or broken URL counts as a host of
its own kind (the empty one); a page alone on its host, or with nothing but copies of itself, is judged by its markup
only; equal lines align in order; repeated rows each get a result.  An empty table gives an empty result.  Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, table

#: Elements whose content is never text of the page.
UNSEEN = frozenset("head script style noscript template iframe object svg canvas math audio video title".split())
#: Elements that hold page furniture.
FURNITURE = frozenset("nav footer aside form button select menu dialog fieldset label input textarea datalist".split())
#: Elements that begin or end a block.
BLOCKS = frozenset(
    "html body main article section header hgroup div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address hr br details summary center".split()
) | FURNITURE
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of a class, id or role that tell page furniture, also within an article.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adslot sponsor sponsored promo promos promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer toolbar comment comments commentlist disqus discussion reply replies respond response responses "
    "notice notices alert cookie cookies consent gdpr newsletter subscribe signup login share sharing social related recommended pagination pager "
    "complementary contentinfo skip".split()
)
#: Parts that tell furniture too, but that may hold an article.
HOLDING_NAMES = frozenset("banner masthead topbar popup modal overlay widget search".split())
#: Parts that turn the others into a statement about the element or make them a topic of its text.
STATING_NAMES = frozenset("has with without no not is are show hide hidden enabled disabled open closed story policy results".split())
#: Elements that never are furniture by their names: they hold the page or its article.
HOLDERS = frozenset("html body main article".split())
#: Open elements that an opening tag closes when their end tag is left out, and the elements that end the search.
CELLS, ROWS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
IMPLIED_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (CELLS, frozenset(("table", "tr")))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (ROWS, frozenset(("table",)))),
    **dict.fromkeys(("option", "optgroup"), (frozenset(("option",)), frozenset(("select", "datalist")))),
}
OPEN_P = frozenset(("p",))
P_SCOPE = frozenset("html body table caption td th button object template".split())
#: A tag as it should be written; what is not is read piece by piece.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+)*+)\s*+(/?)>""")
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TAG_NAME, GAP, ATTRIBUTE, EQUALS, BARE = (re.compile(x) for x in (r"</?([A-Za-z][^\s/>]*)", r"[\s/]*", r"[^\s/>][^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
SPLIT_NAME = re.compile(r"[^a-z]+")
RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "iframe", "title", "svg", "textarea")}
FOREIGN = frozenset(("svg", "math"))


def read_tag(page: str, at: int) -> tuple[int, bool, str, list[str], bool] | None:
    """(end, is an end tag, name, values of class, id and role, is self-closing) of the tag at a place; None if the page ends in it."""
    m = TAG.match(page, at)
    if m:
        return m.end(), bool(m[1]), m[2].lower(), [x or y or z for x, y, z in NAMED.findall(m[3])] if m[3] else [], bool(m[4])
    m = TAG_NAME.match(page, at)
    named, p = [], m.end()
    while True:
        gap = GAP.match(page, p)
        p = gap.end()
        if p >= len(page):
            return None
        if page[p] == ">":
            return p + 1, page[at + 1] == "/", m[1].lower(), named, gap[0].endswith("/")
        attribute = ATTRIBUTE.match(page, p)
        p, value = attribute.end(), ""
        equals = EQUALS.match(page, p)
        if equals:
            p = equals.end()
            if page[p : p + 1] in ("'", '"'):
                end = page.find(page[p], p + 1)
                if end < 0:
                    return None
                value, p = page[p + 1 : end], end + 1
            else:
                bare = BARE.match(page, p)
                value, p = bare[0], bare.end()
        if attribute[0].lower() in ("class", "id", "role"):
            named.append(value)


def furniture_kind(name: str, named: list[str]) -> int:
    """2 for furniture, 1 for furniture that may hold an article, 0 for others."""
    if name in FURNITURE:
        return 1 if name == "form" else 2
    if name in HOLDERS:
        return 0
    kind = 0
    for value in named:
        for word in value.lower().split():
            parts = [p for p in SPLIT_NAME.split(word) if p]
            if not STATING_NAMES.isdisjoint(parts) and not ({"cookie", "cookies"} & set(parts)):
                continue
            if not FURNITURE_NAMES.isdisjoint(parts):
                return 2
            if not HOLDING_NAMES.isdisjoint(parts):
                kind = 1
    return kind


def page_lines(page: str | None) -> list[tuple[str, int]]:
    """(line, mark) of every block in page order; mark 2: in an article, 1: outside, 0: page furniture."""
    if not page:
        return []
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int, bool]] = []  # name, clear furniture, furniture that may hold an article, article
    places: dict[str, list[int]] = {}  # of each name in the stack
    clear = holding = articles = 0

    def flush() -> None:
        if parts:
            line = " ".join(entities.unescape("".join(parts)).split())
            if line:
                lines.append((line, 0 if clear or holding else 2 if articles else 1))
            parts.clear()

    def close(height: int) -> None:
        nonlocal clear, holding, articles
        while len(stack) > height:
            name, hard, soft, article = stack.pop()
            places[name].pop()
            clear -= hard
            holding -= soft
            articles -= article

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close_implied(names: frozenset, scope: frozenset) -> None:
        found = last(names)
        if found > last(scope - names):
            close(found)

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            parts.append(page[at:])
            break
        if begin > at:
            parts.append(page[at:begin])
        then = page[begin + 1 : begin + 3]
        if then[:1] in ("!", "?"):
            comment = page.startswith("<!--", begin)
            end = page.find("-->", begin + 4) if comment else page.find(">", begin)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        if not TAG_NAME.match(page, begin):
            parts.append("<")
            at = begin + 1
            continue
        tag = read_tag(page, begin)
        if tag is None:
            break
        at, ends, name, named, itself = tag
        if name in BLOCKS:
            flush()
        if ends:
            if places.get(name):
                close(places[name][-1])
            continue
        if name in VOID or (itself and name in FOREIGN):
            continue
        if name in RAW_END:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        if name in BLOCKS:
            close_implied(OPEN_P, P_SCOPE)
        if name in IMPLIED_ENDS:
            close_implied(*IMPLIED_ENDS[name])
        if name in ("body", "article", "main") and places.get("head"):
            close(places["head"][-1])
        kind = 2 if name in UNSEEN else furniture_kind(name, named)
        if name == "header" and not articles:
            kind = 2
        if kind == 1 and name == "form" and all(x[0] in ("html", "body") for x in stack[-2:]) and len(stack) <= 2:
            kind = 0  # a form round the whole page; its fields are furniture themselves
        believed = name in ("article", "main") and not clear
        # what holds a believed article does not make it furniture: taken back when the article ends
        soft = -holding if believed else int(kind == 1)
        places.setdefault(name, []).append(len(stack))
        stack.append((name, int(kind == 2), soft, believed))
        clear += kind == 2
        holding += soft
        articles += believed
    flush()
    return lines


def shared_lines(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Positions in a and b of one longest common subsequence, found with a bit for each line of b.

    Lines that only one side has cannot align and are left out first; common beginnings and ends align at once.
    """
    both = set(a) & set(b)
    ia, ib = ([i for i, x in enumerate(s) if x in both] for s in (a, b))
    head = 0
    while head < min(len(ia), len(ib)) and a[ia[head]] == b[ib[head]]:
        head += 1
    tail = 0
    while tail < min(len(ia), len(ib)) - head and a[ia[-1 - tail]] == b[ib[-1 - tail]]:
        tail += 1
    in_a, in_b = set(ia[:head]) | set(ia[len(ia) - tail :]), set(ib[:head]) | set(ib[len(ib) - tail :])
    ma, mb = ia[head : len(ia) - tail], ib[head : len(ib) - tail]
    if ma and mb:
        place: dict[str, int] = {}
        for j, p in enumerate(mb):
            place[b[p]] = place.get(b[p], 0) | 1 << j
        full = (1 << len(mb)) - 1
        row, rows = full, []
        for p in ma:
            hit = row & place.get(a[p], 0)
            row = ((row + hit) | (row - hit)) & full
            rows.append(row)
        j = len(mb) - 1
        for i in range(len(ma) - 1, -1, -1):
            before = rows[i - 1] if i else full
            # zero bits count the length: skip columns that do not lengthen the subsequence here
            while j >= 0 and rows[i] >> j & 1:
                j -= 1
            if j < 0:
                break
            if before >> j & 1:
                in_a.add(ma[i])
                in_b.add(mb[j])
                j -= 1
    return in_a, in_b


def main_text(lines: list[tuple[str, int]], shared: set[int] | None) -> str:
    """Article lines; where none is marked, the lines outside furniture that the neighbour does not share.

    shared is None for a page without a neighbour.
    """
    article = [x for x, m in lines if m == 2]
    return "\n".join(article or [x for i, (x, m) in enumerate(lines) if m and i not in (shared or ())])


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared_lines", pa.int32())])


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


ORDER = ["_host", "_path", "page_id", "_h"]
#: Ranges of pages for each shuffle partition; more of them fill partitions more evenly.
RANGES = 4


def place(host: str, path: str, page_id: int | None, h: int) -> tuple:
    """Key that sorts as ORDER does, nulls first."""
    return host, path, (page_id is not None, page_id or 0), h


def row_keys(batch: pa.RecordBatch):
    return (place(*k) for k in zip(*(batch.column(c).to_pylist() for c in ORDER), strict=True))


def digests(batches):
    """The columns of ORDER and a digest of the page's lines."""
    for b in batches:
        texts = ("\n".join(x for x, _ in page_lines(h)) for h in b.column("html").to_pylist())
        digest = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ORDER), pa.array(digest, pa.binary())], names=[*ORDER, "_digest"])


def range_ends(batches):
    """One row of a sorted range: its first and last page as (key, digest), and the nearest pages of other lines on their hosts.

    The last item says whether the range is one run of equal lines on one host.
    """
    first = after_first = last = before_last = None
    runs = 0
    for b in batches:
        for page in zip(row_keys(b), b.column("_digest").to_pylist(), strict=True):
            if last is None:
                first, runs = page, 1
            elif page[0][0] != last[0][0] or page[1] != last[1]:
                runs += 1
                before_last = last if page[0][0] == last[0][0] else None
                if runs == 2 and before_last:
                    after_first = page
            last = page
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((first, after_first, last, before_last, runs == 1))], pa.binary())], names=["ends"])


def across(ranges: list[tuple]) -> list[tuple | None]:
    """For (entry, entry's other, exit, exit's other, one run) of ranges in walking order, the page that each needs from those walked before."""
    needed, seen, other = [], None, None
    for entry, _, leave, leave_other, one in ranges:
        near = None
        if seen and seen[0][0] == entry[0][0]:
            near = seen if seen[1] != entry[1] else other
        needed.append(near)
        seen, other = leave, near if one else leave_other
    return needed


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_shared_lines of every row of pages (page_id, url, html).

    Keys and digests of lines are sorted by (host, path) first, into ranges whose ends go to the driver.  From these it
    is known which pages a range needs from others: two at most, whatever lies between.  Then pages are dealt by
    range, with these copied into it, and each range is walked run by run of equal lines.  A hot host spans many ranges.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("_host"), path.alias("_path"))
    keyed = keyed.withColumn("_h", F.xxhash64("html"))
    keys = materialize(keyed.mapInArrow(digests, "_host string, _path string, page_id long, _h long, _digest binary"))
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = keys.repartitionByRange(parts, *ORDER[:3]).sortWithinPartitions(*ORDER).mapInArrow(range_ends, "ends binary")
    ranges = sorted((pickle.loads(r["ends"]) for r in ends.collect()), key=lambda r: r[0][0])
    forget(keys)
    starts = [r[0][0][:3] for r in ranges]
    wanted: dict[tuple, set[int]] = {}
    back = across([(last, before, first, after, one) for first, after, last, before, one in reversed(ranges)])[::-1]
    for k, near in enumerate(zip(across(ranges), back, strict=True)):
        for page in near:
            if page:
                wanted.setdefault(page[0], set()).add(k)

    def deal(batches):
        for b in batches:
            at, to, guest = [], [], []
            for i, key in enumerate(row_keys(b)):
                own = max(0, bisect_right(starts, key[:3]) - 1)
                for k in (own, *wanted.get(key, ())):
                    at.append(i)
                    to.append(k)
                    guest.append(k != own)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(at, pa.int64())).columns, pa.array(to, pa.int32()), pa.array(guest, pa.bool_())], names=[*b.schema.names, "_range", "_guest"])

    kinds = ", ".join(f"{c} {t}" for c, t in keyed.dtypes)
    dealt = keyed.mapInArrow(deal, f"{kinds}, _range int, _guest boolean").repartition(parts, "_range").sortWithinPartitions("_range", *ORDER)

    def run(batches):
        def rows():
            for b in batches:
                names = ("page_id", "url", "html", "_path", "_guest", "_range", "_host")
                yield from ((i, u, page_lines(h), path, guest, (k, host)) for i, u, h, path, guest, k, host in zip(*(b.column(c).to_pylist() for c in names), strict=True))

        def results(before, same, after):
            """Of pages with the same lines; before and after are the nearest pages with others."""
            near = [x for x in (before, after) if x is not None]
            found: dict[int, set[int]] = {}
            for i, u, lines, path, guest, _ in same:
                if guest:
                    continue
                shared: set[int] | None = None
                if near:
                    k = max(range(len(near)), key=lambda k: common_start(near[k][3], path))
                    if k not in found:
                        found[k] = shared_lines(texts(lines), texts(near[k][2]))[0]
                    shared = found[k]
                text = main_text(lines, shared)
                yield i, u, text, len(text), len(shared or ())

        def texts(lines):
            return [x for x, _ in lines]

        def runs():
            before, same = None, []
            for page in rows():
                if same and same[-1][5] == page[5]:
                    if same[-1][2] == page[2]:
                        page = (*page[:2], same[-1][2], *page[3:])
                    elif texts(same[-1][2]) != texts(page[2]):
                        yield from results(before, same, page)
                        before, same = same[-1], []
                elif same:
                    yield from results(before, same, None)
                    before, same = None, []
                same.append(page)
            if same:
                yield from results(before, same, None)

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), OUT.types, strict=True)], schema=OUT)

        out, size = [], 0
        for row in runs():
            out.append(row)
            size += row[3]
            if len(out) >= 500 or size > 4 << 20:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared_lines int")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
