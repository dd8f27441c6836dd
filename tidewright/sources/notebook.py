"""Notebook files as a source: figures, metrics and errors of their outputs, and Markdown or LaTeX reports of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The part of the notebook format that is read, and the line a run prints its metric in; both fixed by the format.
CELLS = "struct<cells:array<struct<cell_type:string,source:string,outputs:array<struct<output_type:string,ename:string,evalue:string,text:string,data:map<string,string>>>>>>"
METRIC = r"OOS\s*R.*?:\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"


def joined(text: Column) -> Column:
    """A field that is a string or a list of strings, as one string; none is empty."""
    return F.coalesce(F.array_join(F.from_json(text, "array<string>"), ""), text, F.lit(""))


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """(file, cell, output, source, kind, text, png, ename, evalue), a row per output; one notebook is one row to parse.

    text is a stream's text, or the plain text of other outputs; png a figure in base64 without line breaks, else NULL.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", CELLS).alias("nb"))
    cells = raw.select("file", F.posexplode("nb.cells").alias("cell", "c"))
    each = cells.select("file", "cell", joined(F.col("c.source")).alias("source"), F.posexplode("c.outputs").alias("output", "o"))
    text = F.when(F.col("o.output_type") == "stream", joined(F.col("o.text"))).otherwise(joined(F.col("o.data")["text/plain"]))
    figure = F.col("o.data")["image/png"]
    png = F.when(figure.isNotNull(), F.regexp_replace(joined(figure), "\n", ""))
    return each.select("file", "cell", "output", "source", F.col("o.output_type").alias("kind"), text.alias("text"), png.alias("png"), joined(F.col("o.ename")).alias("ename"), joined(F.col("o.evalue")).alias("evalue"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(file, cell, output, place, r2): every out-of-sample R2 printed."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(METRIC), F.lit(1))).alias("place", "r2")
    return outputs(spark, path).select("file", "cell", "output", found).withColumn("r2", F.col("r2").cast("double"))


def errors(spark: SparkSession, path: str) -> DataFrame:
    return outputs(spark, path).filter("kind = 'error'").select("file", "cell", "output", "ename", "evalue")


def figures(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, cell, output, caption, name, content): the figures of each notebook, numbered from 1 in order."""
    rows = outputs(spark, path).filter("png is not null")
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("file").orderBy("cell", "output")))
    said = F.lower("source")
    caption = (
        F.when(said.contains("monthly_r2.plot") | said.contains("monthly oos"), "Monthly OOS R^2")
        .when(said.contains("diag_dfs") & said.contains("grassmann_dist"), "Intrinsic Dimension and Grassmann Stability")
        .otherwise(F.format_string("Notebook plot %d (cell %d)", "number", "cell"))
    )
    name = F.format_string("plot_%02d_cell%d_out%d.png", "number", "cell", "output")
    return rows.select("file", "number", "cell", "output", caption.alias("caption"), name.alias("name"), F.unbase64("png").alias("content"))


def write_figures(spark: SparkSession, path: str, folder: str) -> list[tuple[int, int, str, str]]:
    """Write a notebook's figures as files to a folder; gives (number, cell, caption, name) of each, in order."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    store = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(base)
    written = []
    for r in figures(spark, path).orderBy("number").toLocalIterator():  # one figure at a time
        out = store.create(jvm.org.apache.hadoop.fs.Path(base, r["name"]), True)
        out.write(bytes(r["content"]))
        out.close()
        written.append((r["number"], r["cell"], r["caption"], r["name"]))
    return written


_TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escape(text: str) -> str:
    return "".join(_TEX.get(c, c) for c in text)


def report(spark: SparkSession, path: str, latex: bool = False, title: str = "Results", folder: str = "figures") -> str:
    """A report of one notebook: its metrics, its figures by name in `folder`, and its errors."""
    r2 = [r["r2"] for r in metrics(spark, path).orderBy("cell", "output", "place").collect()]
    wrong = [(r["cell"], r["ename"], r["evalue"] or "No error message") for r in errors(spark, path).orderBy("cell", "output").collect()]
    seen = [(r["number"], r["cell"], r["caption"], r["name"]) for r in figures(spark, path).drop("content").orderBy("number").collect()]
    text = latex_escape if latex else str
    said = [f"Overall OOS R^2 ({i}): {v:.4f}" for i, v in enumerate(r2, 1)] or ["No OOS R^2 value found in notebook outputs."]
    issues = [f"Cell {c}: {n} - {v}" for c, n, v in wrong] or ["No notebook errors captured in outputs."]
    parts: list[tuple[str, list[str]]] = [("Key Metrics", said), ("Plots", [f"{i}. {c} (cell {cell})" for i, cell, c, _ in seen] or ["No inline plots were found in notebook outputs."]), ("Run Issues", issues)]
    if not latex:
        shown = [f"![{c}]({folder}/{name})" for _, _, c, name in seen]
        blocks = [f"## {head}\n\n" + "\n".join(f"- {x}" for x in lines) + ("\n\n" + "\n".join(shown) if head == "Plots" and shown else "") for head, lines in parts]
        return f"# {title}\n\n" + "\n\n".join(blocks) + "\n"
    lists = [f"\\section*{{{text(head)}}}\n\\begin{{itemize}}\n" + "".join(f"\\item {text(x)}\n" for x in lines) + "\\end{itemize}\n" for head, lines in parts]
    shown = [f"\\begin{{figure}}[h]\n\\centering\n\\includegraphics[width=\\linewidth]{{{folder}/{name}}}\n\\caption{{{text(c)}}}\n\\end{{figure}}\n" for _, _, c, name in seen]
    head = "\\documentclass{article}\n\\usepackage{graphicx}\n\\begin{document}\n"
    return head + f"\\title{{{text(title)}}}\n\\maketitle\n" + "".join([*lists, *shown]) + "\\end{document}\n"
