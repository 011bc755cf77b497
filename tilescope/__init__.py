"""tilescope: tiled rasters, file catalogs, timelines and request streams on Spark DataFrames."""
