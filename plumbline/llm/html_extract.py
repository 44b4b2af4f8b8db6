"""HTML extraction with a site style tree: merged DOMs of a host tell template from content."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._spark import salted_lookup, spool

#: A branch of the style tree below this importance is template; importance is known from LEAST_PAGES pages on.
LEAST_IMPORTANCE = 0.2
LEAST_PAGES = 3
#: Weight that a level of the tree keeps for what lies below it.
GAMMA = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg math canvas object audio video select button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "body", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An opening tag closes an open one of these, up to a list or table around it.
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
NOISE_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notice|notices|popup|modal|overlay|"
    r"navigation|nav|navbar|menu|menubar|breadcrumbs?|sidebar|side-bar|rail|widget|footer|masthead|site-header|page-header|topbar|"
    r"comments?|commentlist|discussion|replies|respond|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|tags|toc|skip-link|copyright|disclaimer)(?=$|[\s_-])",
    re.I,
)
#: Names that mark parts of the article itself where they stand within one.
PARTS = re.compile(r"(?:^|(?<=\s))(?:discussion|related[_-]works?)(?=$|\s)", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def parse(page: str) -> tuple[list[tuple[str, bool, bool, str]], list[tuple[str, str, bool]]]:
    """Blocks (path, noise, main, text) in page order, and styles (path, its children's keys in order, main)."""
    blocks: list[tuple[str, bool, bool, str]] = []
    styles: list[tuple[str, str, bool]] = []
    # of each open block: tag, path, noise, main, keys of its children
    stack: list[tuple[str, str, bool, bool, list[str]]] = [("", "", False, False, [])]
    pieces: list[str] = []
    # tags that nothing further on closes: the rest of the page is searched once for each
    endless: set[str] = set()

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append((stack[-1][1], stack[-1][2], stack[-1][3], text))
            pieces.clear()

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            _, path, _, main, children = stack.pop()
            styles.append((path, " ".join(children), main))

    def close_open(tags: set[str], stop: set[str]) -> None:
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in stop:
                break
            if stack[k][0] in tags:
                found = k
        if found:
            close(found)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if tag in RAW:
            if not closing and not (attributes.endswith("/") and tag in ("svg", "math")):
                end = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if end is None:
                    endless.add(tag)
                if end is None and tag not in ("script", "style", "title", "textarea", "iframe", "noscript", "template", "xmp"):
                    continue  # an unclosed control hides nothing
                at = end.end() if end else n
                pieces.append(" ")
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "head":
            if not closing:
                end = None if tag in endless else re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                if end is None:
                    endless.add(tag)
                else:
                    at = end.start() if end[0].lower().startswith("<body") else end.end()
            continue
        if tag not in BLOCKS:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                flush()
            continue
        flush()
        if tag in VOID:
            continue
        if tag in ("html", "body") and any(s[0] == tag for s in stack):
            continue
        if tag in CLOSES_P:
            close_open({"p"}, {"table", "td", "th"})
        if tag in SAME:
            close_open(*SAME[tag])
        key, noise, main = tag, False, False
        if attributes.strip():
            held = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attributes)}
            names = " ".join(filter(None, (held.get("class"), held.get("id"))))
            if names:
                key += "." + ".".join(sorted(re.sub(r"\d+", "0", names).split()))
            role = held.get("role", "").lower()
            main = role == "main"
            noise = "hidden" in held or role in NOISE_ROLES or bool(names) and tag not in ("html", "body", "article", "main") and NOISE_WORDS.search(PARTS.sub(" ", names) if stack[-1][3] else names) is not None
            if tag in ("article", "main") and names and re.search(r"(?:^|[\s_-])(?:comments?|reply|replies|related|ads?|promo|teaser)(?=$|[\s_-])", names, re.I):
                noise = True
        _, path, above, inside, children = stack[-1]
        children.append(key)
        main = main or tag in ("article", "main")
        noise = above or noise or tag in NOISE_TAGS or tag == "header" and not inside
        stack.append((tag, f"{path}>{key}", noise, inside or main and not noise, []))
    close(1)
    return blocks, styles


def host_of(url: str) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return m[1].lower() if m else ""


def _fold(children: str) -> str:
    """Runs of one key count once."""
    out: list[str] = []
    for key in children.split():
        if not out or out[-1] != key:
            out.append(key)
    return " ".join(out)


_PARSED = "page_id long, url string, host string, article long, blocks array<struct<path:string,noise:boolean,main:boolean,text:string>>, features array<struct<path:string,feature:long,main:boolean>>, styles array<struct<path:string,style:long,main:boolean>>"


def _parse_pages(batches):
    code = lambda s: xxhash.xxh64_intdigest(s) - (1 << 63)
    of = lambda *fields: pa.list_(pa.struct(list(fields)))
    path = ("path", pa.string())
    for b in batches:
        for lo in range(0, b.num_rows, 200):
            part = b.slice(lo, 200)
            rows: list[list] = [[], [], [], []]
            for page in part["html"].to_pylist():
                blocks, styles = parse(page or "")
                rows[0].append([{"path": p, "noise": x, "main": m, "text": t} for p, x, m, t in blocks])
                own = [x for p, noise, m, t in blocks if m and not noise for x in (p, t)]
                within = {p for p, _, m in styles if m}
                rows[1].append([{"path": p, "feature": f, "main": p in within} for p, f in {(p, code(t)) for p, x, _, t in blocks if not x}])
                rows[2].append([{"path": p, "style": s, "main": p in within} for p, s in {(p, code(_fold(c))) for p, c, _ in styles if p}])
                rows[3].append("\0".join(own) if own else None)
            hosts = [host_of(u or "") for u in part["url"].to_pylist()]
            articles = [None if x is None else code(f"{h}\0{x}") for h, x in zip(hosts, rows[3], strict=True)]
            yield pa.record_batch({
                "page_id": part["page_id"], "url": part["url"], "host": pa.array(hosts, pa.string()), "article": pa.array(articles, pa.int64()),
                "blocks": pa.array(rows[0], of(path, ("noise", pa.bool_()), ("main", pa.bool_()), ("text", pa.string()))),
                "features": pa.array(rows[1], of(path, ("feature", pa.int64()), ("main", pa.bool_()))), "styles": pa.array(rows[2], of(path, ("style", pa.int64()), ("main", pa.bool_()))),
            })


def importance(paths: pd.DataFrame) -> dict[str, float]:
    """Composite importance of every node of one host's style tree.

    paths has one row per path: pages, content (a leaf's own importance, null if it has no text) and presentation. A
    node is (1 - GAMMA**l) parts its presentation and GAMMA**l parts the mean of its children, l being their number; its
    own text counts as one more child.
    """
    below: dict[str, list[str]] = defaultdict(list)
    known = set(paths["path"])
    for path in paths["path"]:
        parent = path.rpartition(">")[0]
        if parent in known:
            below[parent].append(path)
    out: dict[str, float] = {}
    for row in sorted(paths.itertuples(), key=lambda r: -r.path.count(">")):
        parts = [out[c] for c in below[row.path]]
        if row.content == row.content and row.content is not None:
            parts.append(row.content)
        if not parts:
            out[row.path] = 1.0
        elif len(parts) == 1 and not below[row.path]:
            out[row.path] = parts[0]
        else:
            keep = GAMMA ** len(parts)
            out[row.path] = (1 - keep) * row.presentation + keep * sum(parts) / len(parts)
    return out


def style_tree(parsed: DataFrame) -> DataFrame:
    """host, pages, low (paths of the host's template branches).

    Content: a text that n of a node's m pages share has entropy log n / log m; a node's importance is 1 less the mean of
    its texts' entropies. Presentation: the entropy, to the base m, of the shares of its child sequences. Both are sums
    of counts, so hosts of any size are aggregated before a shuffle; only a host's distinct paths meet in one task.
    Pages of a host with equal main parts count once within them: a copied article is no template.
    """
    copied = parsed.where("article is not null").groupBy("article").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copied = spool(copied, "copied")
    outside = lambda c: F.when(F.col("first") < F.col("row"), F.filter(c, lambda x: ~x["main"])).otherwise(F.col(c)).alias(c)
    parsed = salted_lookup(parsed, copied, "article", "copies", salt="row").select("host", outside("features"), outside("styles"))
    pages = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    features = parsed.select("host", F.explode("features").alias("f")).groupBy("host", F.col("f.path").alias("path"), F.col("f.feature").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    content = features.groupBy("host", "path").agg(F.avg(F.log("n")).alias("shared"))
    styles = parsed.select("host", F.explode("styles").alias("s")).select("host", "s.path", "s.style").groupBy("host", "path", "style").agg(F.count(F.lit(1)).alias("n"))
    shape = styles.groupBy("host", "path").agg(F.sum("n").alias("uses"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    seen = parsed.select("host", F.explode(F.array_distinct(F.transform("styles", lambda s: s["path"]))).alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("m"))
    nodes = seen.join(shape, ["host", "path"]).join(content, ["host", "path"], "left")
    base = F.log("m")
    nodes = nodes.select(
        "host", "path", "m",
        F.when(F.col("m") > 1, 1 - F.col("shared") / base).otherwise(F.when(F.col("shared").isNotNull(), 1.0)).alias("content"),
        F.when(F.col("m") > 1, F.least(F.lit(1.0), (F.log("uses") - F.col("nlogn") / F.col("uses")) / base)).otherwise(1.0).alias("presentation"),
    )

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        of = importance(pdf)
        many = dict(zip(pdf["path"], pdf["m"], strict=True))
        low = sorted(p for p, x in of.items() if x < LEAST_IMPORTANCE and many[p] >= LEAST_PAGES)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "low": [low]})

    low = nodes.groupBy("host").applyInPandas(prune, "host string, low array<string>")
    return pages.join(low, "host", "left")


def _template(block: dict, low: list[str]) -> bool:
    """Whether the block lies on a branch of low importance. Within the main part only branches that a name or a
    container sets apart count (see also _minor): plain headings, paragraphs, lists and tables there are content even if they repeat."""
    for path in low:
        if block["path"] == path or block["path"].startswith(path + ">"):
            if not block["main"] or _apart(path):
                return True
    return False


def _apart(path: str) -> bool:
    key = path.rpartition(">")[2]
    return "." in key or key in ("div", "section")


def _minor(kept: list[dict], low: list[str]) -> list[str]:
    """low without the branches that hold most of the page's main part, and what lies below them: that is its content,
    even if nearly copied."""
    size = sum(len(x["text"]) for x in kept if x["main"])
    under = lambda path, top: path == top or path.startswith(top + ">")
    most = [p for p in low if _apart(p) and 2 * sum(len(x["text"]) for x in kept if x["main"] and under(x["path"], p)) > size] if size else []
    return [p for p in low if not any(under(p, top) for top in most)]


def _text(batches):
    for b in batches:
        texts = []
        for blocks, low in zip(b["blocks"].to_pylist(), b["low"].to_pylist(), strict=True):
            kept = [x for x in blocks or [] if not x["noise"]]
            kept = [x for x in kept if x["main"]] or kept
            low = _minor(kept, low or [])
            rest = [x for x in kept if not _template(x, low)] if low else kept
            texts.append("\n".join(x["text"] for x in rest or kept))
        yield pa.record_batch({"page_id": b["page_id"], "url": b["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages: the main text of the whole html.

    Branches that are navigation, headers, footers, sidebars, notices, adverts, forms or comments by their tags, roles or
    names go, and so do branches of low importance in their host's style tree. If a page has an article or a main part,
    only that counts. Where nothing would be left, as of an article that all its host's pages copy, all of it
    stays. Blocks are joined by one line feed; white space in a block becomes one space.

    A null html is empty and gives an empty text; a null url is a host of its own; repeated rows are extracted each. An
    empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = spool(rows.mapInArrow(_parse_pages, _PARSED).withColumn("row", F.monotonically_increasing_id()), "parsed")
    low = spool(style_tree(parsed.select("row", "host", "article", "features", "styles")), "styles")
    known = salted_lookup(parsed.select("page_id", "url", "host", "blocks"), low, "host", "pages", salt="page_id")
    return known.select("page_id", "url", "blocks", "low").mapInArrow(_text, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
