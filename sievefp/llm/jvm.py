"""Java sources of this folder as functions of Spark's: compiled by the compiler Spark brings
for its own generated code, and sent to the executors as a jar."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sievefp.llm.common import shared_dir
from sievefp.llm.warc import filesystem


def function(spark: SparkSession, name: str):
    """The class sievefp.<name>, a UDF2 of binary results, as a function of two columns."""
    called = f"sievefp_{name.lower()}"
    if not spark.catalog.functionExists(called):
        made = _load(spark, f"sievefp.{name}", Path(__file__).with_name(f"{name}.java"))
        spark._jsparkSession.udf().register(called, made, spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)

    def call(*columns) -> Column:
        return F.call_function(called, *columns)

    return call


def _load(spark: SparkSession, full: str, source: Path):
    """An object of the class; its jar lies in the shared folder."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(source.read_text(encoding="utf-8"))
    classes, jar = compiler.getBytecodes(), io.BytesIO()
    with zipfile.ZipFile(jar, "w") as out:
        for name in classes:
            out.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
    path = f"{shared_dir(spark)}/jars/{uuid.uuid4().hex}.jar"
    files, inner = filesystem(path.rpartition("/")[0])
    files.create_dir(inner, recursive=True)
    with files.open_output_stream(f"{inner}/{path.rpartition('/')[2]}", compression=None) as out:
        out.write(jar.getvalue())
    spark.sql(f"ADD JAR '{path}'")
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    make = loader.loadClass(full).getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0))
    return make.newInstance(gateway.new_array(jvm.java.lang.Object, 0))
