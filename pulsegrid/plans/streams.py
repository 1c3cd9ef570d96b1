"""Streaming queries, run over the files that are there."""

from ..streaming.desaturations import event_readings, run_to_the_end, stream_desaturations
from ..streaming.windows import epochs, event_rows, event_stream, run_available
from . import query
from .oximetry import DESATURATIONS


EPOCHS_SQL = "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2"


@query("stream_epochs", EPOCHS_SQL)
def stream_epochs(spark, sf_dir):
    return run_available(epochs(event_stream(spark, sf_dir).withWatermark("ts", "1 hour")), ["start_us", "event_type"])


@query("batch_epochs", EPOCHS_SQL)
def batch_epochs(spark, sf_dir):
    return epochs(event_rows(spark, sf_dir))


@query("stream_desaturations", DESATURATIONS)
def desaturation_stream(spark, sf_dir):
    """The events of the batch scan, found reading by reading as files come."""
    return run_to_the_end(spark, event_readings(spark, sf_dir), lambda r: stream_desaturations(r, 3.0, 20, 1))
