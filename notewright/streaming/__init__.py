"""An extension: the same operators on frames that arrive as a stream."""
