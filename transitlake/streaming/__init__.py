"""Streaming: intentionally empty.

The reference has no streaming workload: no change stream, queue, watermark,
window over event time or stateful operator. Its only timer refreshes console
text in the web UI. All of its data is processed in batch (reports, nesting,
dashboard tables), which the other packages implement. Nothing is added here
so as not to build operators the reference does not have.
"""
