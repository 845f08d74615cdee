"""Rules as functions of columns: ``columns`` (native), ``payloads`` and ``chemistry`` (plain Python
for Arrow batches), ``raster`` (numpy).  They take their limits as parameters and know no table."""
