"""The keyed state of change capture as a Java class, compiled when a stream first needs it.

A stateful processor in Python costs a key some half a millisecond, in round trips to the JVM and an Arrow batch, whatever it does.
So millions of keys need one in the JVM. Janino compiles it, which comes with Spark for its generated code; the class goes to
executors as a jar. What a key's changes lead to is the same, and so is the state.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

CLASS = "tierflow.NewestChange"
#: :class:`tierflow.streaming.capture.NewestChange` in Java, without type parameters, which Janino would ignore.
SOURCE = """
package tierflow;

import java.util.Arrays;
import java.util.ArrayList;
import java.util.List;
import org.apache.spark.sql.Encoders;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;
import org.apache.spark.sql.streaming.ExpiredTimerInfo;
import org.apache.spark.sql.streaming.OutputMode;
import org.apache.spark.sql.streaming.StatefulProcessor;
import org.apache.spark.sql.streaming.TTLConfig;
import org.apache.spark.sql.streaming.TimeMode;
import org.apache.spark.sql.streaming.TimerValues;
import org.apache.spark.sql.streaming.ValueState;
import org.apache.spark.sql.types.StructType;
import org.apache.spark.unsafe.types.UTF8String;
import scala.collection.Iterator;

public class NewestChange extends StatefulProcessor {
  private final StructType held;
  private final int[] version;
  private final int op;
  private final int timestamp;
  private final String deleted;
  private final long keepMs;
  private transient ValueState newest;

  public NewestChange(StructType held, int[] version, int op, int timestamp, String deleted, long keepMs) {
    this.held = held;
    this.version = version;
    this.op = op;
    this.timestamp = timestamp;
    this.deleted = deleted;
    this.keepMs = keepMs;
  }

  public void init(OutputMode outputMode, TimeMode timeMode) {
    newest = getHandle().getValueState("newest", Encoders.row(held), TTLConfig.NONE());
  }

  public Iterator handleInputRows(Object key, Iterator rows, TimerValues timerValues) {
    Row before = (Row) newest.get();
    Row best = null;
    while (rows.hasNext()) {
      Row row = (Row) rows.next();
      if (best != null ? compare(row, best, false) > 0 : before == null || compare(row, before, true) > 0) {
        best = row;
      }
    }
    if (best == null) {
      return scala.collection.Iterator$.MODULE$.empty();
    }
    if (before != null && before.getBoolean(version.length)) { // only a tombstone has a timer
      List timers = new ArrayList();
      Iterator listed = getHandle().listTimers();
      while (listed.hasNext()) {
        timers.add(listed.next());
      }
      for (int i = 0; i < timers.size(); i++) {
        getHandle().deleteTimer(((Long) timers.get(i)).longValue());
      }
    }
    boolean gone = deleted.equals(best.get(op));
    Object[] value = new Object[version.length + 1];
    for (int i = 0; i < version.length; i++) {
      value[i] = best.get(version[i]);
    }
    value[version.length] = Boolean.valueOf(gone);
    newest.update(RowFactory.create(value));
    if (gone && !best.isNullAt(timestamp)) {
      getHandle().registerTimer(millis(best.get(timestamp)) + keepMs);
    }
    return scala.collection.Iterator$.MODULE$.single(best);
  }

  public Iterator handleExpiredTimer(Object key, TimerValues timerValues, ExpiredTimerInfo expired) {
    Row before = (Row) newest.get();
    if (before != null && before.getBoolean(version.length)) {
      newest.clear();
    }
    return scala.collection.Iterator$.MODULE$.empty();
  }

  private int compare(Row row, Row other, boolean otherIsHeld) {
    for (int i = 0; i < version.length; i++) {
      int c = order(row.get(version[i]), other.get(otherIsHeld ? i : version[i]));
      if (c != 0) {
        return c;
      }
    }
    return 0;
  }

  /** Spark's order of values, which the table has too; null is older than any. */
  private static int order(Object a, Object b) {
    if (a == null || b == null) {
      return a == b ? 0 : a == null ? -1 : 1;
    }
    if (a instanceof String) {
      return UTF8String.fromString((String) a).binaryCompare(UTF8String.fromString((String) b));
    }
    if (a instanceof byte[]) {
      return Arrays.compareUnsigned((byte[]) a, (byte[]) b);
    }
    if (a instanceof Double || a instanceof Float) {
      double x = ((Number) a).doubleValue();
      double y = ((Number) b).doubleValue();
      return x == y ? 0 : Double.compare(x, y);
    }
    return ((Comparable) a).compareTo(b);
  }

  private static long millis(Object at) {
    return at instanceof java.time.Instant ? ((java.time.Instant) at).toEpochMilli() : ((java.sql.Timestamp) at).getTime();
  }
}
"""
#: Types of a version that the class compares; strings are those of the default collation.
COMPARED = (T.NumericType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)

_CLASSES: dict[str, object] = {}


def can_run(schema: T.StructType, version: T.StructType) -> bool:
    """Whether the class takes these rows: versions of plain types, and no column of a type that only Python knows."""
    plain = all(isinstance(f.dataType, COMPARED) or f.dataType == T.StringType() for f in version)
    return plain and '"udt"' not in schema.json()


def _compiled(spark: SparkSession):
    """The class, compiled and sent to executors once an application."""
    application = spark.sparkContext.applicationId
    if application not in _CLASSES:
        loader = spark._jsparkSession.sharedState().jarClassLoader()
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(loader)
        compiler.cook(SOURCE)
        file, jar = tempfile.mkstemp(prefix="tierflow-state-", suffix=".jar")
        with os.fdopen(file, "wb") as out, zipfile.ZipFile(out, "w") as packed:
            for name, code in compiler.getBytecodes().items():
                packed.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sql(f"ADD JAR '{jar}'")
        _CLASSES[application] = loader.loadClass(CLASS)
    return _CLASSES[application]


def newest_changes(
    stream: DataFrame, keys: Sequence[str], version: T.StructType, held: T.StructType, op: str, timestamp: str, deleted: str, keep_ms: int
) -> DataFrame:
    """``stream`` through the class, with a state for each of its ``keys``."""
    spark = stream.sparkSession
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    sql = jvm.org.apache.spark.sql
    at = gateway.new_array(jvm.int, len(version))
    for i, column in enumerate(version.names):
        at[i] = stream.columns.index(column)
    values = sql.types.DataType.fromJson(held.json()), at, stream.columns.index(op), stream.columns.index(timestamp), deleted, keep_ms
    arguments = gateway.new_array(jvm.Object, len(values))
    for i, value in enumerate(values):
        arguments[i] = value
    processor = _compiled(spark).getConstructors()[0].newInstance(arguments)
    row = sql.Encoders.row(stream._jdf.schema())
    grouped = getattr(stream.groupBy(*keys)._jgd, "as")(sql.Encoders.row(stream.select(*keys)._jdf.schema()), row)
    modes = sql.streaming
    return DataFrame(grouped.transformWithState(processor, modes.TimeMode.EventTime(), modes.OutputMode.Append(), row), spark)
