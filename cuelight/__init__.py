"""Time-coded text analytics on PySpark: cues, detections, events and moments as DataFrames."""
