"""Java code of this folder as functions of Spark's: compiled on the driver by Janino, Spark's own compiler for
the code that it generates, and sent to the executors as a jar."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_COMPILED: dict[str, dict[str, object]] = {}


def _classes(spark: SparkSession, source: str):
    """The compiled classes' loader; executors get them, too."""
    known = _COMPILED.setdefault(spark.sparkContext.applicationId, {})
    if source not in known:
        jvm = spark.sparkContext._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(Path(__file__).with_name(source).read_text(encoding="utf-8"))
        jar = f"{os.path.realpath(tempfile.mkdtemp())}/{Path(source).stem}.jar"
        with zipfile.ZipFile(jar, "w") as z:
            codes = compiler.getBytecodes()
            for name in codes.keySet():
                z.writestr(f"{name.replace('.', '/')}.class", bytes(codes.get(name)))
        spark.sparkContext._jsc.addJar(jar)
        known[source] = compiler.getClassLoader()
    return known[source]


def register(spark: SparkSession, name: str, source: str, class_name: str, *args: bytes) -> str:
    """A function that gives binary, made by the class's constructor; its name for call_udf()."""
    loader, sc = _classes(spark, source), spark.sparkContext
    given = sc._gateway.new_array(sc._jvm.java.lang.Object, len(args))
    for k, x in enumerate(args):
        given[k] = x
    made = loader.loadClass(class_name).getConstructors()[0].newInstance(given)
    spark._jsparkSession.udf().register(name, made, sc._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return name
