"""Main texts of web pages by wrapper induction: DOM trees of same-host pages are aligned by simple tree matching."""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import written
from tidemark.llm.url_rules import host_of

#: Distinct pages of one host that are aligned together, and bytes of them, about; a host of more is aligned in blocks by a hash.
BLOCK, BLOCK_BYTES = 48, 32_000_000
#: A text that this share of a block's distinct pages have at the same node, and at least two pages, is template.
CONSTANT_SHARE = 0.8
#: In blocks of fewer distinct pages, pages that are copies of each other by most of their text make no template.
FEW = 4
#: A slot is entered in search of the article if it has more than this share of the text outside of boilerplate.
HELD = {"article": 0.3, "main": 0.3, "": 0.6}
#: A part that looks like boilerplate is content nevertheless if it has more than this share of all varying text and so many characters of it a page.
NEARLY_ALL, MUCH = 0.8, 200
#: A slot with more than this share of its text in links is a list of links.
LINKS = 0.6
#: Most large hosts whose page counts are sent to every worker; more of them are joined.
SENT_HOSTS = 100_000
#: How markup is packed while it is moved.
CODEC, LEVEL = "zstd", 9
#: Bits of the filter that tells which pages may occur twice.
FILTER_BITS = 1 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = "script|style|textarea|title|noscript|xmp|iframe|template"
#: Elements that are never content, and those that usually aren't.
NEVER = frozenset("head button select option datalist svg canvas object audio video dialog menu nav footer aside input fieldset label".split())
USUALLY_NOT = frozenset(["form"])
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that can hold an article.
CONTAINERS = frozenset("html body main article section div center table tbody tr td form".split())
#: What a class, id or role says of an element that isn't content; whole parts of names.
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar side menu nav navbar navigation breadcrumb breadcrumbs masthead topbar footer cookie cookies consent gdpr "
    "notice notification alert modal popup overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist discussion disqus replies respond widget "
    "toolbar pagination pager login search skip contentinfo complementary hidden paywall".split()
)
ATTRS = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+"
TOKEN = re.compile(rf"(?P<text>[^<]+)|<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b{ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>{ATTRS})>|<[!?/][^>]*>|(?P<stray><)", re.S | re.I)
#: The same for the rest of a page in which a quote is never closed: a tag ends at the next bracket.
PLAIN = re.compile(TOKEN.pattern.replace(ATTRS, "[^>]*"), re.S | re.I)
LABEL = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Which open elements a new one ends, and where the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS |= {tag: ({"p"}, {"article", "aside", "blockquote", "body", "div", "footer", "header", "li", "main", "nav", "section", "table", "td", "th", "form"}) for tag in BLOCKS - ENDS.keys()}


class Node:
    """An element, or the text between two of them (tag '#'). Symbol: what must be equal for two nodes to match."""

    __slots__ = ("children", "label", "linked", "parts", "slot", "symbol", "tag", "text")

    def __init__(self, tag: str, label: str = ""):
        self.tag, self.label, self.text, self.linked = tag, label, "", 0
        self.symbol = f"{tag} {label}" if label else tag
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.slot: Slot | None = None


def parse(source: str) -> Node:
    """A tree out of any markup; unknown, unclosed and stray tags are put up with.

    Inline elements count as their text, unless class, id or role say that they aren't content.
    """
    root = Node("html")
    stack, links = [root], 0
    open_tags: Counter[str] = Counter()
    leaf: Node | None = None
    leaves: list[Node] = []
    scan, place = TOKEN.match, 0

    def add(text: str) -> None:
        nonlocal leaf
        if leaf is None:
            leaf = Node("#")
            leaves.append(leaf)
            stack[-1].children.append(leaf)
        leaf.parts.append(text)
        leaf.linked += len(text) if links else 0

    while m := scan(source, place):
        place = m.end()
        text = m["text"] or m["stray"]
        if text:
            if text == "<" and m["stray"] and source[place : place + 1].isalpha():
                if scan == TOKEN.match:  # a tag that no bracket ends, as a quote is left open
                    scan, place = PLAIN.match, place - 1
                    continue
                text += source[place:]  # no bracket follows
                place = len(source)
            add(text)
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE and stack[-1].tag != tag:
                continue
            if tag == "p" and open_tags["p"] == 0:
                leaf = None
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    open_tags[stack.pop().tag] -= 1
                open_tags[stack.pop().tag] -= 1
                leaf = None
            continue
        if tag == "html" or (tag == "body" and open_tags["body"]):
            continue
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            if any(open_tags[t] for t in ended):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ended:
                        for n in stack[i:]:
                            open_tags[n.tag] -= 1
                        del stack[i:]
                        break
                    if stack[i].tag in bounds:
                        break
            leaf, links = None, 0
        attrs = m["attrs"]
        label = _label(attrs) if attrs else ""
        if tag not in BLOCKS and tag not in NEVER and not (label and not NOT_CONTENT.isdisjoint(label.split())):
            if tag == "br":
                add(" ")
            elif tag == "a" and not attrs.endswith("/"):
                links += 1
            continue
        node = Node(tag, label)
        stack[-1].children.append(node)
        leaf = None
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    for x in leaves:
        x.text = " ".join(html.unescape("".join(x.parts)).split())
    return root


#: Elements that are only in the tree if they are labelled; an end tag ends them if they are the last one open.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())


def _label(attrs: str) -> str:
    """Class, id and role as words; 'hidden' if the element isn't shown."""
    words = []
    for name, *values in LABEL.findall(attrs):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            words.append("hidden")
        elif name in ("class", "id", "role"):
            words += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return " ".join(words)


class Slot:
    """A node of a folded tree or of a wrapper: what like siblings have in common is one slot.

    nodes: those of the page that is folded. Of a wrapper: on how many pages it is, whether several on most, and what varies in it.
    """

    __slots__ = ("boiler", "chars", "children", "label", "linked", "many", "nodes", "pages", "parent", "symbol", "tag", "texts")

    def __init__(self, node: Node | Slot, parent: Slot | None = None):
        self.tag, self.label, self.symbol, self.parent = node.tag, node.label, node.symbol, parent
        self.children: list[Slot] = []
        self.nodes: list[Node] = []
        self.texts: Counter[str] = Counter()
        self.pages = self.many = self.chars = self.linked = 0
        self.boiler = False


def fold(root: Node) -> Slot:
    """A page's tree with siblings of equal symbol, and so their children, folded into one slot each."""
    top = Slot(root)
    top.nodes.append(root)
    todo = [top]
    while todo:
        slot = todo.pop()
        groups: dict[str, Slot] = {}
        for n in slot.nodes:
            for c in n.children:
                if (g := groups.get(c.symbol)) is None:
                    g = groups[c.symbol] = Slot(c, slot)
                g.nodes.append(c)
        slot.children = list(groups.values())
        todo += slot.children
    return top


Matching = tuple[int, list]


def _matching(a: Slot, b: Slot) -> Generator[tuple[Slot, Slot], Matching, Matching]:
    """Asks for the matchings of pairs of children as it goes; nested lists hold its pairs."""
    x, y = a.children, b.children
    if len(x) == len(y) and all(c.symbol == d.symbol for c, d in zip(x, y, strict=True)) and len({c.symbol for c in x}) == len(x):
        total, pairs = 1, [(a, b)]  # only one way is the largest
        for c, d in zip(x, y, strict=True):
            size, inner = (1, [(c, d)]) if c.tag == "#" else (yield c, d)
            total += size
            pairs.append(inner)
        return total, pairs
    cells: dict[tuple[int, int], Matching] = {}
    for i, c in enumerate(x):
        for j, d in enumerate(y):
            if c.symbol == d.symbol:
                cells[i, j] = (1, [(c, d)]) if c.tag == "#" else (yield c, d)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        row, above = best[i + 1], best[i]
        for j in range(len(y)):
            cell = cells.get((i, j))
            row[j + 1] = max(above[j + 1], row[j], above[j] + cell[0] if cell else 0)
    i, j, pairs = len(x), len(y), [(a, b)]
    while i and j:
        cell = cells.get((i - 1, j - 1))
        if cell and best[i][j] == best[i - 1][j - 1] + cell[0]:
            pairs.append(cell[1])
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1] + 1, pairs


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the size of the largest order-preserving matching of two trees with equal roots, and its pairs. Trees may be of any depth."""
    if a.symbol != b.symbol:
        return 0, []
    calls, answer = [_matching(a, b)], None
    while calls:
        try:
            asked = calls[-1].send(answer)
            calls.append(_matching(*asked))
            answer = None
        except StopIteration as e:
            answer = e.value
            calls.pop()
    pairs: list[tuple[Slot, Slot]] = []
    todo = [answer[1]]
    while todo:
        for x in todo.pop():
            if isinstance(x, list):
                todo.append(x)
            else:
                pairs.append(x)
    return answer[0], pairs


def induce(pages: list[Slot]) -> Slot:
    """The wrapper of some folded pages: each slot of a page is aligned with one of the wrapper, or put into it where it stands.

    Nodes of the pages get their slot of the wrapper.
    """
    wrapper = Slot(pages[0])
    for page in pages:
        partner = {id(d): c for c, d in match(wrapper, page)[1]}
        todo = [(wrapper, page)]
        while todo:
            c, d = todo.pop()
            c.pages += 1
            c.many += len(d.nodes) > 1
            for n in d.nodes:
                n.slot = c
            if d.tag == "#":
                c.texts.update({n.text for n in d.nodes})
            place = 0
            for child in d.children:
                own = partner.get(id(child))
                if own is None:
                    own = Slot(child, c)
                    c.children.insert(place, own)
                    place += 1
                else:
                    place = next((k for k in range(place, len(c.children)) if c.children[k] is own), place - 1) + 1
                todo.append((own, child))
    return wrapper


def _looks_boiler(slot: Slot) -> bool:
    if slot.tag == "header":
        return slot.parent is None or slot.parent.tag in ("html", "body") or not NOT_CONTENT.isdisjoint(slot.label.split())
    return slot.tag in NEVER or slot.tag in USUALLY_NOT or bool(slot.label and slot.tag not in ("html", "body") and not NOT_CONTENT.isdisjoint(slot.label.split()))


def judge(wrapper: Slot, pages: int, template: set[tuple[int, str]]) -> set[int]:
    """ids of the slots of the wrapper that hold content, by what varies in them on all pages together.

    The article is where most of the varying text is: from the root the search goes into one slot after the other that has
    enough of what isn't boilerplate and isn't one of several. All in it but boilerplate is content, and so are
    headings h1 before it. Boilerplate by name is content if it has nearly all text there is.
    """
    order = [wrapper]
    for s in order:
        order += s.children
    for s in reversed(order):
        if s.tag == "#":
            s.chars = sum(len(t) * n for t, n in s.texts.items() if (id(s), t) not in template)
        if s.parent:
            s.parent.chars += s.chars
            s.parent.linked += s.linked
    everything = wrapper.chars
    for s in order:
        named = _looks_boiler(s)
        saved = named and s.tag not in NEVER and s.chars > NEARLY_ALL * everything and s.chars > MUCH * pages
        links = s.tag != "#" and s.linked > LINKS * max(1, s.chars) and s.tag in ("ul", "ol", "div", "section", "table", "dl")
        s.boiler = (named and not saved) or links or bool(s.parent and s.parent.boiler)
    net = {id(s): 0 for s in order}
    for s in reversed(order):
        if s.tag == "#" and not s.boiler:
            net[id(s)] += s.chars
        if s.parent:
            net[id(s.parent)] += net[id(s)]
    main, path = wrapper, []
    while True:
        into = [c for c in main.children if c.tag in CONTAINERS and not c.boiler and 2 * c.many <= c.pages and net[id(c)] > HELD.get(c.tag, HELD[""]) * net[id(main)]]
        if not into:
            break
        path.append(main)
        main = max(into, key=lambda c: net[id(c)])
        path.append(main)
    content, todo = set(), [main]
    inner = {id(x) for x in path}
    for above in path:
        for c in above.children:
            if id(c) in inner:
                break
            if c.tag == "h1" and not c.boiler:
                todo.append(c)
    while todo:
        s = todo.pop()
        if not s.boiler:
            content.add(id(s))
            todo += s.children
    for s in path:
        content.add(id(s))
    return content


def text_of(root: Node, content: set[int], template: set[tuple[int, str]]) -> str:
    """Blocks of the content's varying slots, joined by an empty line. A block is kept whole if any of its texts varies."""
    blocks: list[str] = []
    parts: list[str] = []
    varies = False

    def flush() -> None:
        nonlocal varies
        if varies and (text := " ".join(x for x in parts if x)):
            blocks.append(text)
        parts.clear()
        varies = False

    todo: list[Node | None] = [root]
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif node.tag == "#":
            if id(node.slot) in content and node.text:
                parts.append(node.text)
                varies = varies or (id(node.slot), node.text) not in template
        elif id(node.slot) in content:
            if node.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(node.children)
        elif node.tag in BLOCKS:
            flush()
    flush()
    return "\n\n".join(blocks)


def _alike(a: Node, b: Node) -> bool:
    """Whether most of the text of one of two pages is in the other."""
    found = []
    for tree in (a, b):
        texts, todo = Counter(), [tree]
        while todo:
            n = todo.pop()
            todo += n.children
            if n.tag == "#":
                texts[n.text] += len(n.text)
        found.append(texts)
    return 2 * (found[0] & found[1]).total() > min(found[0].total(), found[1].total())


def main_texts(sources: list[str], use_wrapper: bool = True) -> list[str]:
    """Texts of pages of one host. Equal pages are one page: copies of an article don't make a template of it.

    Without the wrapper, which is for tests, all text of a page is a slot and every slot is content.
    """
    if not sources:
        return []
    trees: dict[str, Node] = {}
    for s in sources:
        if s not in trees:
            trees[s] = parse(s)
    folded = [fold(t) for t in trees.values()]
    wrapper = induce(folded)
    order, leaves = [wrapper], []
    for s in order:
        order += s.children
        if s.tag == "#":
            leaves.append(s)
    least = max(2, CONSTANT_SHARE * len(trees))
    template = {(id(s), t) for s in leaves for t, n in s.texts.items() if n >= least}
    if len(trees) < FEW and all(_alike(a, b) for a, b in itertools.combinations(trees.values(), 2)):
        template = set()
    for t in trees.values():
        todo = [t]
        while todo:
            n = todo.pop()
            todo += n.children
            if n.tag == "#" and n.linked and (id(n.slot), n.text) not in template:
                n.slot.linked += min(n.linked, len(n.text))
    content = judge(wrapper, len(trees), template)
    if not use_wrapper:
        content, template = {id(s) for s in order}, set()
    texts = {s: text_of(tree, content, template) or text_of(tree, content, set()) for s, tree in trees.items()}
    return [texts[s] for s in sources]


def extract_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text and n_chars.

    Distinct pages of one host are aligned in blocks of about BLOCK pages, dealt by a hash of their markup. Each page's markup is moved once, to its
    block; pages that may occur twice are grouped first, and their text is joined to all of their rows. The wrapper of a block decides by what
    varies, and where most of it is, which slots are the article; menus, footers, sidebars, notices, adverts, forms, comments and lists of
    links in it are left out. Null and empty pages have an empty text, as have pages without content; null URLs
    are a host of their own; repeated rows give repeated results; if a page's whole article is on most pages of its block, it is kept.
    Extra columns are not read.
    """
    kind = pages.schema[id_col].dataType
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("digest", F.unhex(F.md5("html")))
    seen = written(rows.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("html")).alias("bytes")), "pages-seen")
    hosts = written(seen.groupBy("host").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks")).where("blocks > 1"), "pages-hosts")
    slot = F.pmod(F.xxhash64("digest", "host"), F.lit(FILTER_BITS))
    bits = seen.where("n > 1").select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    tested = rows.withColumn("s", slot).withColumn("word", F.shiftright("s", 6)).join(F.broadcast(bits), "word", "left")
    tested = tested.withColumn("again", F.expr("bits is not null and (shiftright(bits, cast(s & 63 as int)) & 1) = 1")).select("id", "url", "html", "host", "digest", "again")
    once = tested.where("not again").select("id", "url", "html", "host", "digest", F.lit(False).alias("again"))
    copied = tested.where("again").groupBy("host", "digest").agg(F.first("html").alias("html")).select(F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("url"), "html", "host", "digest", F.lit(True).alias("again"))
    sized = F.broadcast(hosts) if hosts.count() <= SENT_HOSTS else hosts
    blocked = once.unionByName(copied).join(sized, "host", "left").withColumn("block", F.pmod(F.xxhash64("digest"), F.coalesce("blocks", F.lit(1))))
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("url string, host string, digest binary, again boolean, text string, n_chars long").fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC, compression_level=LEVEL)
        for batch in batches:
            raw = batch.column("html").cast(pa.binary()).to_pylist()
            packed = [codec.compress(x, asbytes=True) if x else b"" for x in raw]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(packed, pa.binary()), pa.array([len(x) for x in raw], pa.int64())], [*carried, "packed", "bytes"])

    def extract(group: pa.Table) -> pa.Table:
        packed = zip(group["packed"].to_pylist(), group["bytes"].to_pylist(), strict=True)
        texts = main_texts([pa.decompress(x, n, CODEC, asbytes=True).decode("utf-8", "replace") if n else "" for x, n in packed])
        return group.select(["id", "url", "host", "digest", "again"]).append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of rows sorted by host and block; the last group of a batch waits for the next one."""
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None else now
            if not len(now):
                continue
            keys = list(zip(now["host"].to_pylist(), now["block"].to_pylist(), strict=True))
            starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            for a, b in zip(starts, starts[1:], strict=False):
                yield from extract(now.slice(a, b - a)).to_batches()
            rest = now.slice(starts[-1])
        if rest is not None and len(rest):
            yield from extract(rest).to_batches()

    carried = ["id", "url", "host", "digest", "again", "block"]
    packed = blocked.select(*carried, "html").mapInArrow(pack, T.StructType([*blocked.select(*carried).schema.fields, *T.StructType.fromDDL("packed binary, bytes long").fields]))
    once_only = F.when(F.col("again"), F.col("digest")).alias("digest")
    found = written(packed.repartition("host", "block").sortWithinPartitions("host", "block").mapInArrow(by_block, schema).select("id", "url", F.when(F.col("again"), F.col("host")).alias("host"), once_only, "again", "text", "n_chars"), "pages-texts", "zstd")
    single = found.where("not again").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
    ids = tested.where("again").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "digest")
    return single.unionByName(ids.join(found.where("again").select("host", "digest", "text", "n_chars"), ["host", "digest"]).select(id_col, url_col, "text", "n_chars"))
