"""DataFrame operators: conversion, ledger, layout and validation."""
