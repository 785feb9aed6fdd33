"""daybars: a Spark-native engine for daily price bars.

Ingest fixed-width master files and landed JSON quote responses, keep the
code and bar tables current through keyed upserts, plan which date windows
are still missing per code, and derive day-over-day change-rate features.
Everything is DataFrame code; nothing is collected to the driver.
"""

__version__ = "0.1.0"
