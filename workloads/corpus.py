"""Inputs derived from the given tables: a corpus of small source files over
``orders``, dependencies over ``lineitem`` and advisories over ``part``."""

from __future__ import annotations

import io
import math
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

# (extension, text); "{k}" becomes the order key, "{aws}" a token-shaped string
# that is put together at run time.
TEMPLATES: list[tuple[str, str]] = [
    (".php", '$firstname = $_POST["firstname"];\n'
             "$sql = \"SELECT lastname FROM users WHERE firstname='$firstname'\";\n"
             "$result = mysqli_query($conn, $sql);\n"),
    (".py", 'q = request.args.get("q")\nsafe = escape(q)\ncursor.execute(safe)\ncursor.execute(q)\n'),
    (".py", 'x = input()\ny = x\nx = "const"\nos.system(x)\nos.system(y)\n'),
    (".py", 'v = request.args.get("v")\nw = v.strip()\neval(w)\nsubprocess.run(v)\nos.popen(w)\n'),
    (".js", "const q = req.query.name;\nel.innerHTML = q;\ndocument.write(q);\n"
            "el.innerHTML = DOMPurify.sanitize(q);\n"),
    (".js", "const token = Math.random();\nlet n = Math.random();\nmerge({}, req.body);\n"),
    (".c", "#include <string.h>\nint main(int argc, char **argv) {\n  char buf[8];\n  strcpy(buf, argv[1]);\n"
           '  printf(buf);\n  printf("%s", buf);\n  // gets(buf);\n}\n'),
    (".java", 'String id = request.getParameter("id");\nstmt.executeQuery("select * from t where id=" + id);\n'
              'MessageDigest md = MessageDigest.getInstance("MD5");\n'
              'Cipher c = Cipher.getInstance("DES/ECB/PKCS5Padding");\n'
              'Cipher d = Cipher.getInstance("DESede/CBC/PKCS5Padding");\n'),
    (".py", 'api_key = "k{k}abcdef"\npassword = "changeme"\ndb_password = "hunter{k}"\nDEBUG = True\n'
            "requests.get(url, verify=False)\n"),
    (".php", '$n = $_GET["n"];\necho $n;\necho htmlspecialchars($n);\nsetcookie("a", "b");\n'
             'setcookie("a", "b", secure: true);\nprint_r($n);\n'),
    (".html", '<html><body>\n<a href="javascript:alert({k})">x</a>\n<script>\nvar h = location.hash;\n'
              'document.getElementById("o").innerHTML = h;\n</script>\n</body></html>\n'),
    (".txt", "a = input()\nb = a\ncursor.execute(b)\ncursor.execute(z)\nmd5(x)\n"),
    (".txt", "p = q\nq = p\nq = argv[1]\nsystem(p)\n"),
    (".py", 'hashlib.md5(hashlib.sha1(b"x").digest())\n'),
    (".py", 're.compile("(a+)+$")\nre.compile("a+b")\n'),
    (".py", 'aws = "{aws}"\n'),
    (".py", 'jwt.decode(t, key, algorithms=["none"])\n'),
    (".py", 'print("hello {k}")\n'),
    (".js", 'const u = location.search;\nwindow.location = u;\nlocation.href = u;\nlink.href = "/home";\n'),
    (".py", "app.run(debug=True)\n"),
]
#: Most files that one task builds, give or take.
FILES_PER_TASK = 200_000
ECOSYSTEMS = ["PyPI", "npm", "Maven", "Go", "Debian"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per order."""
    orders = table(spark, sf_dir, "orders")
    return code_files(spread(orders, orders.count()))


def spread(orders: DataFrame, n_orders: int) -> DataFrame:
    """Keys of orders, in a table or a stream of so many."""
    return spread_by(orders.select("o_orderkey", "o_custkey"), n_orders, "o_orderkey")


def spread_by(keys: DataFrame, n_keys: int, name: str) -> DataFrame:
    """Keys fit in one input split; they are spread before texts are built on them, as a real
    source tree of that size would be."""
    tasks = max(keys.sparkSession.sparkContext.defaultParallelism * 2, math.ceil(n_keys / FILES_PER_TASK))
    return keys.repartition(tasks, name)


def code_files(orders: DataFrame) -> DataFrame:
    """``src_files`` built on order keys, with the template number."""
    key = F.col("o_orderkey").cast("string")
    tid = (F.col("o_orderkey") % len(TEMPLATES)).cast("int")
    ext = F.element_at(F.array(*[F.lit(e) for e, _ in TEMPLATES]), tid + 1)
    body = F.element_at(F.array(*[F.lit(t) for _, t in TEMPLATES]), tid + 1)
    aws = F.concat(F.lit("AKIA"), F.lpad(key, 16, "0"))
    content = F.replace(F.replace(body, F.lit("{k}"), key), F.lit("{aws}"), aws)
    file_name = F.concat(F.lit("f"), key, ext)
    return orders.select(
        F.concat(F.lit("repo"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), file_name).alias("path"),
        file_name.alias("file_name"), content.alias("content"), tid.alias("tid"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    eco = F.element_at(F.array(*[F.lit(e) for e in ECOSYSTEMS]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return (table(spark, sf_dir, "lineitem")
            .select(F.concat(F.lit("proj"), F.col("l_orderkey").cast("string")).alias("project"),
                    F.concat(F.lit("pkg"), (F.col("l_partkey") % 700).cast("string")).alias("package"),
                    F.when(F.col("l_linenumber") != 7, eco).alias("ecosystem"))
            .distinct())


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    eco = F.element_at(F.array(*[F.lit(e) for e in ECOSYSTEMS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("ADV-"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")).alias("summary"),
        F.concat(F.lit("pkg"), (F.col("p_partkey") % 500).cast("string")).alias("package"),
        eco.alias("ecosystem"))


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Seeds and edges of one small cyclic graph per order."""
    li = table(spark, sf_dir, "lineitem")
    path = F.col("l_orderkey").cast("string").alias("path")
    dst = (F.col("l_suppkey") % 5).cast("string")
    seeds = li.where("l_linenumber = 1").select(path, dst.alias("var")).distinct()
    edges = li.select(path, (F.col("l_partkey") % 5).cast("string").alias("src"), dst.alias("dst")).distinct()
    return seeds, edges


def write_archives(docs: DataFrame, folder: str) -> None:
    """A ZIP archive ``a<n>.zip`` per value of ``archive``, of bounded size, with a member
    ``d<doc_id>.txt`` per row; beside every third one a copy without its end."""
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
            for doc, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                z.writestr(f"d{doc}.txt", text or "")
        system, root = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
        system.create_dir(root)
        n, data = key[0].as_py(), blob.getvalue()
        for name, part in [(f"a{n}.zip", data)] + [(f"a{n}x.zip", data[:-30])] * (n % 3 == 0):
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(part)
        return pa.table({"archive": [n]})

    docs.groupBy("archive").applyInArrow(pack, "archive long").count()
