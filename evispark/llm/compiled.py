"""Java loops inside the executors, compiled by the Janino that comes with Spark, so no other compiler is needed.

For work that depends on every step before it, and where neither numpy nor an
expression of Spark can advance many rows at once.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_classes: dict[tuple[str, str], JavaObject] = {}


def instance(spark: SparkSession, name: str) -> JavaObject:
    """A new object of the class ``evispark.name``, from the file ``name.java`` beside this one; executors get the class as a jar."""
    sc = spark.sparkContext
    key = sc.applicationId, name
    if key not in _classes:
        jvm = sc._jvm
        with open(os.path.join(os.path.dirname(__file__), f"{name}.java"), encoding="utf-8") as f:
            source = f.read()
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        jar = os.path.join(tempfile.mkdtemp(prefix="evispark-"), f"evispark-{name}.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for path, code in compiler.getBytecodes().items():
                z.writestr(path.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(jar)
        urls = sc._gateway.new_array(jvm.java.net.URL, 1)
        urls[0] = jvm.java.io.File(jar).toURI().toURL()
        _classes[key] = jvm.java.net.URLClassLoader(urls, jvm.java.lang.Thread.currentThread().getContextClassLoader()).loadClass(f"evispark.{name}")
    return _classes[key].getDeclaredConstructor(sc._gateway.new_array(sc._jvm.java.lang.Class, 0)).newInstance(sc._gateway.new_array(sc._jvm.java.lang.Object, 0))


def map_partitions(df: DataFrame, function: JavaObject, schema: str) -> DataFrame:
    """Rows that a Java ``MapPartitionsFunction`` makes of each partition's rows."""
    spark = df.sparkSession
    made = spark._jsparkSession.parseDataType(StructType.fromDDL(schema).json())
    return DataFrame(df._jdf.mapPartitions(function, spark._jvm.org.apache.spark.sql.Encoders.row(made)), spark)
