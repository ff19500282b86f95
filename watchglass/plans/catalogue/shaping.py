"""SHP*: parsing and event time over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import shaping
from .common import events, plain_times


def _syslog(spark, sf):
    """Lines in both syslog formats, every 11th broken, parsed back into columns."""
    df = events(spark, sf)
    line = F.expr("""
      CASE WHEN event_id % 11 = 0 THEN concat('no syslog ', event_type)
           WHEN event_id % 2 = 0 THEN concat('<', user_id % 192, '>1 ',
             date_format(event_time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), ' host', user_id, ' ', event_type,
             ' ', event_id, ' ID', user_id, ' [k@1 a="b"][z c="d"] value ', value)
           ELSE concat('<', user_id % 192, '>', date_format(event_time, 'MMM '),
             lpad(day(event_time), 2, ' '), date_format(event_time, ' HH:mm:ss'), ' host', user_id, ' ', event_type,
             '[', event_id, ']: value ', value) END""")
    out = shaping.parse_syslog(df.select("event_id", line.alias("message")), year=2024)
    return plain_times(out.select(
        "event_id", "timestamp", "hostname", "appname", "procid", "msgid", "version", "severity",
        "facility", "structured_data", "message", "syslog_ok",
    ))


_NAMES = (
    "['kern', 'user', 'mail', 'daemon', 'auth', 'syslog', 'lpr', 'news', 'uucp', 'cron', 'authpriv', 'ftp', 'ntp',"
    " 'security', 'console', 'solaris-cron', 'local0', 'local1', 'local2', 'local3', 'local4', 'local5', 'local6',"
    " 'local7']"
)


def _event_time(spark, sf):
    df = events(spark, sf)
    text = F.expr("""
      CASE event_id % 4 WHEN 0 THEN date_format(event_time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        WHEN 1 THEN CAST(unix_seconds(event_time) AS STRING)
        WHEN 2 THEN concat(date_format(event_time, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00')
        ELSE 'yesterday' END""")
    stamped = shaping.attach_event_time(df.withColumn("timestamp", text), "timestamp")
    return plain_times(stamped.select("event_id", "event_time"))


def _remap(spark, sf):
    out = shaping.remap(
        events(spark, sf),
        lambda d: d.where("value > 5").withColumn("value", F.round(F.col("value") * 2, 4)).drop("props"),
    )
    return shaping.remap(out).select("event_id", "event_type", "value")


QUERIES = {
    "shp_syslog": (
        _syslog,
        f"""SELECT event_id,
          CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN ts ELSE date_trunc('second', ts) END AS timestamp,
          CASE WHEN event_id % 11 <> 0 THEN 'host' || user_id END AS hostname,
          CASE WHEN event_id % 11 <> 0 THEN event_type END AS appname,
          CASE WHEN event_id % 11 <> 0 THEN CAST(event_id AS VARCHAR) END AS procid,
          CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 0 THEN 'ID' || user_id END AS msgid,
          CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 0 THEN 1 END AS version,
          CASE WHEN event_id % 11 <> 0 THEN ['emerg', 'alert', 'crit', 'err', 'warning', 'notice', 'info', 'debug']
            [user_id % 192 % 8 + 1] END AS severity,
          CASE WHEN event_id % 11 <> 0 THEN {_NAMES}[user_id % 192 // 8 + 1] END AS facility,
          CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 0 THEN '[k@1 a="b"][z c="d"]' END AS structured_data,
          CASE WHEN event_id % 11 = 0 THEN 'no syslog ' || event_type ELSE 'value ' || value END AS message,
          event_id % 11 <> 0 AS syslog_ok FROM events""",
    ),
    "shp_event_time": (
        _event_time,
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts)"
        " WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS event_time FROM events",
    ),
    "shp_remap": (
        _remap, "SELECT event_id, event_type, round(value * 2, 4) AS value FROM events WHERE value > 5",
    ),
}
