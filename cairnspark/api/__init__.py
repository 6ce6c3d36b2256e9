"""The catalog's operations as functions of DataFrames and arguments.

A node table has the columns id, parent, path, name, kind ('d', 'f' or 'l'), project, sha256, size, mtime_ns, created; the
root is id 1 and the trash id 2. Every function returns a DataFrame and runs nothing; mutations return the next version.
"""
