from daybars.streaming.catchup import make_batch_writer, quote_stream, start_catchup  # noqa: F401
