"""Inventories of front-end build output: file kinds, HTML references, imports, source maps."""

from __future__ import annotations

import posixpath
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import ordered_case

# Extensions by kind, rank of reference kinds, schemes of local sources.
SCRIPT_EXTENSIONS = [".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"]
TEXT_EXTENSIONS = [".html", ".htm", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".css", ".json", ".map"]
REFERENCE_RANK = {"manifest": 4, "style": 3, "script": 2, "asset": 1}
LOCAL_SCHEMES = ["webpack", "rollup", "vite", "parcel", "browserify", "ng", "esbuild", "turbopack", "snowpack"]
SCRIPT_PRELOADS = ["script", "worker", "serviceworker", "sharedworker", "module"]
ICON_RELATIONS = {"icon", "apple-touch-icon", "mask-icon", "shortcut"}
RAW_TEXT_TAGS = {"script", "style", "textarea", "title"}
IMPORT_SUFFIXES = ["", ".js", ".ts", ".tsx", ".mjs", ".cjs"]

REFERENCES = "html_path string, seq int, path string, kind string, tag string, attribute string"


def file_kind(path: Column) -> Column:
    """The kind of a file by its extension; JSON is a manifest only if the path says so."""
    low = F.lower(path)
    extension = F.regexp_extract(low, r"[^/.][^/]*?(\.[^./]*)$", 1)
    manifest = F.contains(low, F.lit("manifest")) | low.endswith("package.json")
    return ordered_case(
        [
            (extension.isin(".html", ".htm"), "html"),
            (extension.isin(SCRIPT_EXTENSIONS), "script"),
            (extension == ".css", "style"),
            (extension == ".map", "source_map"),
            ((extension == ".json") & manifest, "manifest"),
            (extension.isin(TEXT_EXTENSIONS), "unknown"),
        ],
        "asset",
    )


def inventory(files: DataFrame) -> DataFrame:
    """(path, kind, size, hash) of a ``binaryFile`` scan; ``node_modules`` and ``.git`` are left out."""
    kept = files.where(~F.col("path").rlike(r"(^|/)(node_modules|\.git)(/|$)"))
    return kept.select("path", file_kind(F.col("path")).alias("kind"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def reference_path(value: str | None, html_path: str) -> str | None:
    """A reference as a path of the package, or None for anchors, other hosts, schemes and paths that leave it."""
    text = (value or "").strip().replace("\\", "/")
    text = re.split("[?#]", text, maxsplit=1)[0]
    if not text or text.startswith("//") or re.match(r"[A-Za-z][A-Za-z\d+.-]*:", text):
        return None
    base = "" if text.startswith("/") else posixpath.dirname(html_path)
    path = posixpath.normpath(posixpath.join(base, text.lstrip("/") if text.startswith("/") else text))
    return None if path in (".", "..") or path.startswith("../") else path


class _Scanner(HTMLParser):
    """Collects (kind, value, tag, attribute); comments and raw text hold no tags."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found: list[tuple[str, str, str, str]] = []
        self.raw: str | None = None

    def handle_starttag(self, tag, attrs):
        if self.raw:
            return
        if tag in RAW_TEXT_TAGS:
            self.raw = tag
        self.collect(tag, dict(attrs))

    def handle_startendtag(self, tag, attrs):
        if not self.raw:
            self.collect(tag, dict(attrs))

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = None

    def add(self, kind: str, value: str | None, tag: str, attribute: str) -> None:
        if value:
            self.found.append((kind, value, tag, attribute))

    def add_set(self, value: str | None, tag: str) -> None:
        for part in (value or "").split(","):
            self.add("asset", (part.split() or [""])[0], tag, "srcset")

    def collect(self, tag: str, a: dict[str, str | None]) -> None:
        if tag == "script":
            self.add("script", a.get("src"), tag, "src")
        elif tag == "link":
            relations = set((a.get("rel") or "").lower().split())
            preload = (a.get("as") or "").lower()
            kinds = [("stylesheet", "style"), ("modulepreload", "script"), ("manifest", "manifest")]
            for relation, kind in kinds:
                if relation in relations:
                    self.add(kind, a.get("href"), tag, "href")
            if "preload" in relations:
                self.add("script" if preload in SCRIPT_PRELOADS else preload if preload in ("style", "manifest") else "asset", a.get("href"), tag, "href")
            if relations & ICON_RELATIONS:
                self.add("asset", a.get("href"), tag, "href")
        elif tag in ("img", "audio", "embed", "track", "source", "video") or (tag == "input" and (a.get("type") or "").lower() == "image"):
            self.add("asset", a.get("src"), tag, "src")
            if tag in ("img", "source"):
                self.add_set(a.get("srcset"), tag)
            if tag == "video":
                self.add("asset", a.get("poster"), tag, "poster")
        elif tag == "object":
            self.add("asset", a.get("data"), tag, "data")
        elif tag == "image":
            self.add("asset", a.get("href", a.get("xlink:href")), tag, "href")


def page_references(html: str | None, path: str) -> list[tuple[int, str, str, str, str]]:
    """(seq, path, kind, tag, attribute), the first of each kind and path."""
    scanner = _Scanner()
    scanner.feed(html or "")
    seen, out = set(), []
    for kind, value, tag, attribute in scanner.found:
        target = reference_path(value, path)
        if target and (kind, target) not in seen:
            seen.add((kind, target))
            out.append((len(out), target, kind, tag, attribute))
    return out


def html_references(pages: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The references of HTML pages to files of their package."""

    def scan(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, *r) for p, c in zip(frame["path"], frame["content"], strict=True) for r in page_references(c, p)]
            yield pd.DataFrame(rows, columns=["html_path", "seq", "path", "kind", "tag", "attribute"])

    return pages.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(scan, REFERENCES)


def referenced_kinds(references: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ref_kind): the kind of highest rank by which known files are referenced."""
    rank = F.create_map(*[F.lit(x) for pair in REFERENCE_RANK.items() for x in pair])
    known = references.join(files.select("path").distinct(), "path", "left_semi")
    return known.groupBy("path").agg(F.max(F.struct(rank[F.col("kind")].alias("rank"), "kind")).alias("top")).select("path", F.col("top.kind").alias("ref_kind"))


def missing_references(references: DataFrame, files: DataFrame) -> DataFrame:
    return references.join(files.select("path").distinct(), "path", "left_anti").select(F.concat("html_path", F.lit(" -> "), "kind", F.lit(":"), "path").alias("missing")).distinct()


def with_reference_kinds(files: DataFrame, kinds: DataFrame) -> DataFrame:
    """Assets and unknown files take the kind by which they are referenced."""
    return files.join(kinds, "path", "left").withColumn("kind", F.when(F.col("kind").isin("asset", "unknown"), F.coalesce("ref_kind", "kind")).otherwise(F.col("kind"))).drop("ref_kind")


def first_existing(candidates: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path): of ordered candidates (``position``, ``candidate``) the first that is a file."""
    found = candidates.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return found.groupBy(*keys).agg(F.min(F.struct("position", "candidate")).alias("first")).select(*keys, F.col("first.candidate").alias("path"))


def normal_path(path: Column) -> Column:
    """Without ``.`` and with ``..`` resolved; one that leads out keeps its ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, p)))
    return F.array_join(folded, "/")


def import_candidates(imports: DataFrame) -> DataFrame:
    """(importer, source, position, candidate) for relative, bare and extensionless imports; URLs and ``#`` aliases have none."""
    source = F.split(F.replace(F.trim("source"), F.lit("\\"), F.lit("/")), "[?#]")[0]
    usable = imports.where(~F.col("source").rlike(r"^\s*(#|$)|^(?!file:)[a-zA-Z][a-zA-Z0-9+.-]*:")).withColumn("s", source).where("s <> ''")
    directory = F.regexp_extract("importer", r"^(.*/)?[^/]*$", 1)
    beside = normal_path(F.concat(directory, F.col("s")))
    base = F.when(F.col("s").startswith("."), F.array(beside)).otherwise(F.array(F.regexp_replace("s", r"^\.?/", ""), beside))
    suffixes = F.when(F.contains("s", F.lit(".")), F.array(F.lit(""))).otherwise(F.array(*[F.lit(x) for x in IMPORT_SUFFIXES]))
    every = F.flatten(F.transform(base, lambda b: F.transform(suffixes, lambda x: F.concat(b, x))))
    return usable.select("importer", "source", F.posexplode(every).alias("position", "candidate"))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, source, path): path is null where no script of the package is meant."""
    scripts = files.where(F.col("kind").isin("script", "unknown"))
    return imports.join(first_existing(import_candidates(imports), scripts, ["importer", "source"]), ["importer", "source"], "left")


def source_path(source: Column) -> Column:
    """The path of a source-map source, without leading slashes: local schemes before a slash are taken off, other schemes and blank texts give null."""
    clean = F.nullif(F.trim(F.replace(F.trim(source), F.lit("\\"), F.lit("/"))), F.lit(""))
    scheme = F.regexp_extract(clean, r"^([a-zA-Z][a-zA-Z0-9+.-]*):/+.+$", 1)
    inner = F.when(scheme == "", clean).when(F.lower(scheme).isin(LOCAL_SCHEMES), F.regexp_replace(clean, r"^[^:]+:/+", ""))
    return F.regexp_replace(F.regexp_replace(inner, r"^\./", ""), "^/+", "")


def source_map_sources(maps: DataFrame) -> DataFrame:
    """(map_path, position, source, content) of readable maps; a source without content has null."""
    doc = F.from_json("content", "struct<version: int, file: string, sourceRoot: string, sources: array<string>, sourcesContent: array<string>>")
    some = maps.select(F.col("path").alias("map_path"), doc.alias("d")).where("d.sources is not null")
    some = some.select("map_path", "d.sourcesContent", F.posexplode("d.sources").alias("position", "source"))
    return some.select("map_path", "position", source_path(F.col("source")).alias("source"), F.get("sourcesContent", F.col("position")).alias("content"))


def bundle_paths(maps: DataFrame, files: DataFrame) -> DataFrame:
    """(map_path, path): the file a map names beside it, or the map's own name without .map, whichever comes first and exists; else the latter."""
    named = F.get_json_object("content", "$.file")
    directory = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    own = F.regexp_replace("path", r"\.map$", "")
    rows = maps.select(F.col("path").alias("map_path"), own.alias("own"), F.posexplode(F.array(normal_path(F.concat(directory, named)), own)).alias("position", "candidate"))
    found = first_existing(rows.where("candidate is not null"), files, ["map_path"])
    return rows.select("map_path", "own").distinct().join(found, "map_path", "left").select("map_path", F.coalesce("path", "own").alias("path"))


def package_hash(files: DataFrame, key: str) -> DataFrame:
    """One digest of each package over its sorted (path, hash) lines. A package's list of files is bounded by its archive limits."""
    return files.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "hash"))), lambda f: F.concat(f["path"], F.lit("\u0000"), f["hash"])), "\n"), 256).alias("digest"))


def short_symbol_share(symbols: DataFrame, key: str) -> DataFrame:
    """(key, share, obfuscated): names of one or two characters among a package's symbols; half of them tells of minified input."""
    share = F.avg(F.when(F.length("name").between(1, 2), 1.0).otherwise(0.0))
    return symbols.groupBy(key).agg(share.alias("share")).withColumn("obfuscated", F.col("share") >= 0.5)


def symbol_rank(symbols: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most referenced symbols of each package, names breaking ties."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("references").desc(), F.col("name").asc()))
    return symbols.withColumn("rank", rank).where(F.col("rank") <= k)


def import_usage(usages: DataFrame) -> DataFrame:
    """One row for each (package, importer, specifier): sorted imported and re-exported names, and whether a default, a namespace or everything is taken, or nothing.

    ``usages`` has name and exported_as (null where none) and the booleans default_import, namespace_import, side_effect_only, export_all; null is false.
    """
    flags = ["default_import", "namespace_import", "side_effect_only", "export_all"]
    names = lambda column: F.array_sort(F.collect_set(column))
    return usages.groupBy("package", "importer", "specifier").agg(names("name").alias("names"), names("exported_as").alias("exported"), *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags])


def missing_dependencies(usage: DataFrame, paths: DataFrame) -> DataFrame:
    """The relative imports that meet no file: (package, importer, specifier, resolved_path, reason, status).

    ``paths`` has package, path, is_file, for directories too. A path that leaves the package is unsafe, one that is no file is a conflict; for the others, which
    are missing, a placeholder is generated.
    """
    clean = F.split("specifier", "[?#]")[0]
    directory = F.regexp_extract("importer", r"^(.*/)?[^/]*$", 1)
    joined = F.concat(directory, clean)
    resolved = normal_path(joined)
    relative = usage.where(F.col("specifier").startswith("./") | F.col("specifier").startswith("../")).select("package", "importer", "specifier", resolved.alias("resolved_path"), (F.contains(clean, F.lit("\\")) | joined.startswith("/") | (resolved == "..") | resolved.startswith("../")).alias("unsafe"))
    held = paths.groupBy("package", F.col("path").alias("resolved_path")).agg(F.bool_or("is_file").alias("is_file"))
    found = relative.join(held, ["package", "resolved_path"], "left").where("unsafe or is_file is null or not is_file")
    reason = F.when(F.col("unsafe"), "unsafe_relative_dependency").when(F.col("is_file").isNotNull(), "dependency_path_conflict").otherwise("missing_static_relative_dependency")
    generated = ~F.col("unsafe") & F.col("is_file").isNull()
    return found.select("package", "importer", "specifier", F.when(~F.col("unsafe"), F.col("resolved_path")).alias("resolved_path"), reason.alias("reason"), F.when(generated, "generated").otherwise("unsupported").alias("status"))


def symbol_references(tokens: DataFrame) -> DataFrame:
    """(file, name, references) of the declared names of each file, from identifiers (file, position, name, role).

    A role is ``top`` for a declaration at the top of its file, ``declare`` for one further in, else ``use``. A name counts from its first declaration on, that itself included; names with a declaration
    at the top are known from the start. Names without any are not listed. Two partial aggregates and an equi-join, so that a name in very many places is no group.
    """
    # Only declarations are asked for the first one, and uses travel without their role.
    first = F.min(F.when(F.col("role") == "top", F.lit(-1)).otherwise(F.col("position")))
    since = tokens.where(F.col("role").isin("top", "declare")).groupBy("file", "name").agg(first.alias("since")).where("since is not null")
    return tokens.select("file", "name", "position").join(since, ["file", "name"]).where("position >= since").groupBy("file", "name").agg(F.count(F.lit(1)).alias("references"))
