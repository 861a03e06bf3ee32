"""Text chunks, snippets and query expansion (TXT-4 to TXT-7, SNP-1, HYB-5) as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text as T

# Search synonyms, related terms in order of use.
SYNONYMS = {
    "error": ["bug", "issue", "problem", "exception", "failure"], "bug": ["error", "issue", "defect", "problem"], "issue": ["problem", "bug", "error", "concern"], "exception": ["error", "crash", "failure", "thrown"], "crash": ["exception", "failure", "error", "abort"],
    "api": ["endpoint", "interface", "service", "route"], "endpoint": ["api", "route", "path", "url"], "route": ["endpoint", "path", "url", "api"], "function": ["method", "procedure", "routine", "handler"], "method": ["function", "procedure", "operation"],
    "handler": ["callback", "listener", "function"], "callback": ["handler", "listener", "hook"], "array": ["list", "collection", "sequence"], "list": ["array", "collection", "items"], "object": ["instance", "entity", "record"], "map": ["dictionary", "hash", "hashmap"], "dictionary": ["map", "hash", "object"],
    "database": ["db", "datastore", "storage"], "query": ["search", "lookup", "fetch", "retrieve"], "schema": ["structure", "model", "definition"], "migration": ["upgrade", "change", "update"], "component": ["widget", "element", "module"], "button": ["btn", "control", "action"], "modal": ["dialog", "popup", "overlay"], "form": ["input", "fields", "submission"],
    "test": ["spec", "check", "verify", "validate"], "unit test": ["spec", "test case"], "mock": ["stub", "fake", "double"], "config": ["configuration", "settings", "options"], "settings": ["config", "preferences", "options"], "option": ["setting", "parameter", "flag"],
    "auth": ["authentication", "login", "authorization"], "authentication": ["auth", "login", "signin"], "authorization": ["auth", "permissions", "access"], "login": ["signin", "authenticate", "auth"], "password": ["credential", "secret", "passphrase"], "token": ["jwt", "key", "credential"], "encryption": ["crypto", "cipher", "encrypt"],
    "performance": ["speed", "optimization", "efficiency"], "optimize": ["improve", "enhance", "speed up"], "cache": ["memoize", "store", "buffer"], "state": ["data", "store", "context"], "store": ["state", "repository", "cache"], "file": ["document", "asset", "resource"], "upload": ["import", "submit", "send"], "download": ["export", "fetch", "retrieve"],
    "deploy": ["release", "publish", "ship"], "build": ["compile", "bundle", "package"], "install": ["setup", "configure", "add"], "dependency": ["package", "module", "library"], "refactor": ["restructure", "rewrite", "improve"],
}


def sliding_windows(c, window: int, overlap: int) -> Column:
    """array<struct<chunk_index,start,content>>: windows of ``window`` characters that overlap, the last one at the end (TXT-6)."""
    text = F.coalesce(F.col(c), F.lit(""))
    step = window - overlap
    starts = F.when(F.length(text) <= window, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.ceil((F.length(text) - window) / step) * step).cast("int"), F.lit(step)))
    return F.transform(starts, lambda s, i: F.struct(i.alias("chunk_index"), s.alias("start"), F.substring(text, s + 1, F.lit(window)).alias("content")))


def chars_per_token(c) -> Column:
    """4 in prose, 3.5 in code, mixed by the share of code."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    code = F.aggregate(F.regexp_extract_all(text, F.lit(T.CODE_SPANS), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(F.length(text) == 0, 4.0).otherwise(4.0 - 0.5 * code / F.length(text))


def word_windows(text: Column, chunk_tokens: int, overlap: float) -> Column:
    """array<struct<start,end>>: windows of ``chunk_tokens`` at the text's own rate that overlap and begin and end between words (TXT-6).

    A fold carries the place on. A window ends after the last white space that it holds, the next begins after the last one before a step; white space is
    looked for in the last half of a step, and where there is none the cut lies inside the word.
    """
    # bound as lambda variables, so that each is computed once
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def made(t, window):
        step = window - F.floor(window * overlap).cast("int")
        half = F.floor(step / 2).cast("int")
        last = F.length(t)

        def edge(at):
            part = F.substring(t, at - half + 1, half)
            found = F.length(F.regexp_extract(part, r"(?s)^.*\s", 0))
            return F.when(found > 0, at - half + found).otherwise(at)

        def one(a, _):
            end = F.when(a["at"] + window >= last, last).otherwise(edge(a["at"] + window))
            nothing_left = (a["at"] >= last) | a["over"]
            return F.when(nothing_left, a).otherwise(bind(end, lambda e: F.struct(edge(a["at"] + step).alias("at"), (e >= last).alias("over"), F.concat(a["done"], F.array(F.struct(a["at"].alias("start"), e.alias("end")))).alias("done"))))

        zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("over"), F.array().cast("array<struct<start:int,end:int>>").alias("done"))
        return F.aggregate(F.sequence(F.lit(0), (2 * last / step).cast("int") + 1), zero, one, lambda a: a["done"])

    return bind(text, lambda t: bind(F.floor(chunk_tokens * chars_per_token(t)).cast("int"), lambda window: made(t, window)))


def sentences(c) -> Column:
    """Sentences without loss: joined, they give the text back (TXT-4)."""
    return F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(r"(?s)```.*?(?:```|\z)\s*|.+?(?:[.!?](?=\s|\z)\s*|\n+|(?=```)|\z)"), F.lit(0))


#: Sentences beyond the hard limit are packed of words: as many as fit, a longer word by itself.
def _word_packs(sentence: Column, hard_max: int) -> Column:
    def cut(n: int) -> Column:
        return F.regexp_extract_all(sentence, F.lit(rf"(?s).{{1,{n}}}(?:\s+|\z)|.{{1,{n}}}"), F.lit(0))

    return F.when(sentence.contains("`"), cut(int(hard_max * 3.5))).otherwise(cut(hard_max * 4))


def packed_sentences(text: Column, chunk_tokens: int, overlap_tokens: int, hard_max: int = 500) -> Column:
    """array<struct<start,end>>: sentences packed to chunks of about ``chunk_tokens`` less ``overlap_tokens`` (TXT-5).

    When a chunk is full, its last sentences are carried into the next, as many as ``overlap_tokens`` hold, if the next sentence fits in beside them.
    A sentence beyond ``hard_max`` is packed of words. Chunks without what is carried give the text back.
    """
    size = T.estimated_tokens
    whole = F.flatten(F.transform(sentences(text), lambda s: F.when(size(s) <= hard_max, F.array(s)).otherwise(_word_packs(s, hard_max))))
    units = F.transform(whole, lambda u: F.struct(F.length(u).alias("n"), size(u).alias("t")))
    kind = "array<struct<start:int,t:bigint>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("open"), F.lit(0).cast("bigint").alias("total"), F.array().cast("array<struct<start:int,end:int>>").alias("done"))
    total = lambda rows: F.aggregate(rows, F.lit(0).cast("bigint"), lambda s, x: s + x["t"])
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def step(a, u):
        tail = F.filter(a["open"], lambda _, k: (k > 0) & (total(F.slice(a["open"], k + 1, F.size(a["open"]))) <= overlap_tokens))
        full = (F.size(a["open"]) > 0) & (a["total"] + u["t"] > chunk_tokens - overlap_tokens)
        none = F.array().cast(kind)
        kept = F.when(~full, a["open"]).otherwise(bind(tail, lambda x: F.when(total(x) + u["t"] <= chunk_tokens, x).otherwise(none)))
        done = F.when(full, F.concat(a["done"], F.array(F.struct(F.get(a["open"], F.lit(0))["start"].alias("start"), a["at"].alias("end"))))).otherwise(a["done"])
        return bind(kept, lambda k: F.struct((a["at"] + u["n"]).alias("at"), F.concat(k, F.array(F.struct(a["at"].alias("start"), u["t"].alias("t")))).alias("open"), (total(k) + u["t"]).alias("total"), done.alias("done")))

    last = lambda a: F.when(F.size(a["open"]) == 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(F.get(a["open"], F.lit(0))["start"].alias("start"), a["at"].alias("end")))))
    return F.aggregate(units, zero, step, last)


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk_tokens: int = 450, overlap: float = 0.1, strategy: str = "sentence", hard_max: int = 500) -> DataFrame:
    """One row a chunk with its place in the text; a text within ``chunk_tokens`` is one chunk (TXT-7). Strategies: sentence, paragraph (the same), sliding_window."""
    if strategy not in ("sentence", "paragraph", "sliding_window"):
        raise ValueError(f"no such strategy: {strategy}")
    if not 0 <= overlap < 1 or chunk_tokens < 1:
        raise ValueError("chunks overlap by a share from 0 to less than 1 and hold a token at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = word_windows(text, chunk_tokens, overlap) if strategy == "sliding_window" else packed_sentences(text, chunk_tokens, int(chunk_tokens * overlap), hard_max)
    one = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    spans = F.when(T.estimated_tokens(text) <= chunk_tokens, one).otherwise(made)
    rows = docs.select(F.col(id_col).alias("message_id"), text.alias("_text"), spans.alias("_spans"))
    rows = rows.select("message_id", "_text", F.size("_spans").alias("total_chunks"), F.posexplode("_spans").alias("chunk_index", "_span"))
    rows = rows.select("message_id", "total_chunks", "chunk_index", F.col("_span.start").alias("start"), F.col("_span.end").alias("end"), F.expr("substring(_text, _span.start + 1, _span.end - _span.start)").alias("content"))
    return rows.withColumn("estimated_tokens", T.estimated_tokens("content"))


def expansions(query: str, custom: dict[str, list[str]] | None = None, limit: int = 3) -> list[str]:
    """The query and its variants with one word replaced by a synonym, ``limit`` variants at most (HYB-5)."""
    known = {**SYNONYMS, **(custom or {})}
    words, out = query.lower().split(), []
    for i, w in enumerate(words):
        for s in known.get(w, []):
            v = " ".join([*words[:i], s, *words[i + 1 :]])
            if v != query.lower() and v not in out:
                out.append(v)
    return [query, *out[:limit]]


# Words that a snippet does not look for, in order.
STOP_WORDS = "the a an and or but in on at to for of with by is it as be was are were been has have had do does did will would could should may might can this that these those i you we they he she".split()


def snippet(c, query: str, window: int = 200, step: int = 10, mark: str = "**") -> Column:
    """The window with the most query words, grown to whole words, its hits marked, cut ends shown by ellipses (SNP-1).

    Every place of every term (two letters or more, no stop word; inside words too) counts 2 for a window that holds it and 1 for one that
    cuts it; a window that begins a sentence gets 0.5 more. Counts come from sorted places, so a text costs its windows and hits, not their
    product. Without a hit the text's beginning is shown.
    """
    terms = [w for w in dict.fromkeys(query.lower().split()) if len(w) >= 2 and w not in STOP_WORDS]

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        import re

        import numpy as np

        hit = re.compile("|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)), re.I) if terms else None
        opens = re.compile(r"[.!?]\s*$")

        def begin(text: str) -> str:
            if len(text) <= window:
                return text
            end = next((k for k in range(window, 0, -1) if text[k].isspace()), window)
            return text[:end].strip() + "..."

        def one(text: str | None) -> str:
            text = text or ""
            low = text.lower() if len(text.lower()) == len(text) else "".join(x.lower() if len(x.lower()) == 1 else x for x in text)
            places = {t: np.array([m.start() for m in re.finditer(f"(?={re.escape(t)})", low)], np.int64) for t in terms}
            if not sum(map(len, places.values())):
                return begin(text)
            first, last = 0, len(text)
            if len(text) > window:
                starts = np.arange(0, len(text) - window + 1, step)
                score = np.array([0.5 if s == 0 or opens.search(text[max(0, s - 5) : s]) else 0.0 for s in starts.tolist()])
                for t, at in places.items():
                    whole = np.searchsorted(at, starts + window - len(t), "right") - np.searchsorted(at, starts, "left")
                    touched = np.searchsorted(at, starts + window, "left") - np.searchsorted(at, starts - len(t), "right")
                    score += np.maximum(whole, 0) + touched
                first = int(starts[score.argmax()])
                last = first + window
                while first > 0 and not text[first - 1].isspace():
                    first -= 1
                while last < len(text) and not text[last].isspace():
                    last += 1
            shown = text[first:last].strip()
            return ("..." if first > 0 else "") + (hit.sub(lambda m: f"{mark}{m[0]}{mark}", shown) if mark else shown) + ("..." if last < len(text) else "")

        return texts.map(one)

    return cut(F.coalesce(F.col(c), F.lit("")))
