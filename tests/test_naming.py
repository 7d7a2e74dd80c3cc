"""Output names against naming one source after the other."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from dossier.operators import naming


def safe(part, most=96):
    part = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", part).rstrip(" .") or "_"
    if part.split(".")[0].upper() in naming.RESERVED:
        part = "_" + part
    return part if len(part) <= most else f"{part[: most - 13]}~{hashlib.sha256(part.encode()).hexdigest()[:12]}"


def split(source):
    path = re.sub("/+", "/", source.replace("\\", "/"))
    folder, _, name = path.rpartition("/")
    stem, ext = name.rsplit(".", 1) if "." in name else (name, "")
    return path, folder, stem, naming.EXTENSIONS.get("." + ext.lower())


def plain(sources, occupied, previous):
    taken = {re.sub("/+", "/", p.replace("\\", "/")).lower() for p in occupied}
    known = sorted({s for s in sources if split(s)[3]}, key=lambda s: (split(s)[0].lower(), split(s)[0], s))
    out, owned = {}, set()
    for s in known:
        if s in previous and previous[s].lower() not in owned:
            owned.add(previous[s].lower())
            out[s] = (previous[s], True)
    taken |= owned
    for s in known:
        _, folder, stem, ext = split(s)
        where = "/".join(map(safe, folder.split("/"))) + "/" if folder else ""
        base = re.sub("-译$", "", safe(stem + "-译", 173))
        k = 1
        while s not in out:
            name = f"{where}{base}-译{f' ({k})' if k > 1 else ''}{ext}"
            if name.lower() not in taken:
                taken.add(name.lower())
                out[s] = (name, False)
            k += 1
    return out


def test_one_after_the_other(spark):
    r = random.Random(3)
    stems = ["a", "A", "b", "a-译", "a (2)", "con", "x:y", "x_y", "q?", "q*", "名"]
    for seed in range(3):
        sources = [f"{r.choice(['', 'in/', 'In/', 'c d/e/', 'aux/'])}{r.choice(stems)}{r.choice(['', ' 1', ''])}.{r.choice(['doc', 'docx', 'DOCX', 'xls', 'xlsx', 'pdf', 'txt'])}" for _ in range(150)] + ["noext", "z\\w.doc", "z//w.docx"]
        occupied = [f"{r.choice(['', 'in/', 'IN\\'])}{r.choice(['a', 'A', 'b', 'x_y', 'other'])}-译{r.choice(['', ' (2)', ' (3)', ' (4)', ' (7)'])}.{r.choice(['docx', 'xlsx', 'pdf'])}" for _ in range(40)]
        known = [s for s in sources if split(s)[3]]
        previous = {} if seed == 0 else {r.choice(known): f"in/{r.choice(['a', 'b', 'kept'])}-译{r.choice(['', ' (2)', ' (5)'])}.docx" for _ in range(12)} | {"gone.doc": "in/a-译.docx"}
        df = spark.createDataFrame([(s,) for s in sources], "source string").repartition(3)
        prior = spark.createDataFrame(list(previous.items()), "source string, output string") if seed else None
        got = naming.plan(df, spark.createDataFrame([(p,) for p in occupied], "path string"), prior).collect()
        assert {x.source: (x.output, x.reused) for x in got} == plain(sources, occupied, previous)
        assert len(got) == len({x.output.lower() for x in got})
    assert any(x.number > 3 for x in got) and any(x.renamed for x in got) and not all(x.renamed for x in got)


def test_long_names_and_nothing(spark):
    sources = spark.createDataFrame([("d" * 120 + "/" + "s" * 300 + ".pdf",)], "source string")
    none = spark.createDataFrame([], "path string")
    row = naming.plan(sources, none).first()
    folder, name = row.output.split("/")
    assert len(folder) == 96 and len(name) <= 180 and row.renamed
    assert naming.plan(sources.limit(0), none).count() == 0


def test_extensions(spark):
    got = spark.createDataFrame([("a.DOC",), ("a.b.xls",), ("a.rtf",), ("doc",)], "p string").select(naming.output_extension(F.col("p"))).collect()
    assert [x[0] for x in got] == [".docx", ".xlsx", None, None]
