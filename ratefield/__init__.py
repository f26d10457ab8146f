"""ratefield: event rates over areal units, expressed as Spark DataFrame plans."""
