"""Folders of the driver's tables, under a module name that no other test folder uses."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
