"""The same operators on live streams; results equal those of the batch forms, whatever the batches."""
