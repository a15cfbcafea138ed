"""NetCDF files as a Spark data source, where the netCDF4 library is there.

``spark.dataSource.register(NetcdfSource)``, then ``spark.read.format("netcdf_panel").option("variable", "sm").load(glob)``:
one row a cell and time, fill values NULL, one partition a file and block of latitudes.
"""

from __future__ import annotations

import glob

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Latitudes of a partition, times of a batch.
BLOCK, TIMES = 40, 16


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf_panel"

    def schema(self) -> str:
        return "lat double, lon double, ts timestamp_ntz, value double"

    def reader(self, schema):
        return NetcdfReader(self.options)


class Block(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class NetcdfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.variable = options["path"], options["variable"]
        self.names = [options.get("lat", "lat"), options.get("lon", "lon"), options.get("time", "time")]

    @staticmethod
    def _open(path: str):
        try:
            import netCDF4
        except ImportError as e:
            raise RuntimeError("reading NetCDF needs the netCDF4 library; Parquet and CSV need nothing") from e
        return netCDF4.Dataset(path)

    def partitions(self):
        out = []
        for path in sorted(glob.glob(self.path)):
            with self._open(path) as data:
                n = len(data[self.names[0]])
            out += [Block(path, i, min(i + BLOCK, n)) for i in range(0, n, BLOCK)]
        return out

    def read(self, partition):
        """Arrow batches of ``TIMES`` times and the partition's latitudes."""
        import netCDF4
        import numpy as np

        lat, lon, time = self.names
        with self._open(partition.path) as data:
            times = np.array(netCDF4.num2date(data[time][:], data[time].units, only_use_cftime_datetimes=False, only_use_python_datetimes=True), "datetime64[us]")
            lats, lons = np.asarray(data[lat][partition.first : partition.last], float), np.asarray(data[lon][:], float)
            for t in range(0, len(times), TIMES):
                block = np.ma.filled(data[self.variable][t : t + TIMES, partition.first : partition.last, :].astype(float), np.nan)
                yield cells(block, times[t : t + TIMES], lats, lons)


def cells(block, times, lats, lons):
    """A (time, latitude, longitude) block as a batch of lat, lon, ts, value rows; NaN is NULL."""
    import numpy as np
    import pyarrow as pa

    t, i, j = block.shape
    value = block.ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.tile(np.repeat(lats, j), t)), pa.array(np.tile(lons, t * i)), pa.array(np.repeat(times, i * j)), pa.array(value, mask=np.isnan(value))], ["lat", "lon", "ts", "value"])
